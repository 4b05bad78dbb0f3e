import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemma.operators import expand, relations as R, similar, stats, versions
from stemma.streaming import visits


def test_smith_waterman():
    assert similar.smith_waterman("abc", "xabcy") == (6, "x<mark>abc</mark>y")
    assert similar.smith_waterman("", "x") == (0, "x") and similar.smith_waterman("q", "x") == (0, "x")
    assert similar.smith_waterman("abcd", "abxcd")[0] == 7


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "y" * 50 + "z" * 20), (2, "short"), (3, "")], "id long, content string")
    rows = [(r.id, r.chunk, r.tag, len(r.content)) for r in similar.chunks(docs, "id", "content").orderBy("id", "chunk").collect()]
    assert rows == [(1, 0, "start", 100), (1, 1, "end", 70), (2, 0, "end", 5)]


def test_diff():
    assert versions.diff("如是我聞", "如是你聞了") == "如是<del>我</del><ins>你</ins>聞<ins>了</ins>"
    assert versions.diff("a [x+y] b", "a b") == "a <del>[x+y] </del>b"


def test_compare(spark):
    old = spark.createDataFrame([("a", "如是我聞"), ("b", "一時佛在"), ("c", "同")], "k string, t string")
    new = spark.createDataFrame([("a", "如是，我聞。"), ("b", "一時佛住"), ("d", "新"), ("c", "同")], "k string, t string")
    got = {r.k: (r.change, r.kind, r.ins_chars, r.del_chars) for r in versions.compare(old, new, "k", "t").collect()}
    assert got == {"a": ("changed", "punctuation", 2, 0), "b": ("changed", "text", 1, 1), "d": ("added", "text", 1, 0)}


def test_outline(spark):
    rows = [("w", i, d) for i, d in enumerate([1, 2, 2, 3, 1, 2, 3, 3, 1])]
    out = R.outline(spark.createDataFrame(rows, "w string, i int, d int"), "w", "i", "d").orderBy("i")
    assert [r.number for r in out.collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1", "2.1.1", "2.1.2", "3"]


def test_stable_ids(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    known = spark.createDataFrame([("a", "old")], "k string, uuid string")
    first, again = (sorted(map(tuple, R.stable_ids(keys, known, "k", "uuid").collect())) for _ in range(2))
    assert first == again and first[0] == ("a", "old") and len(first[1][1]) == 36


def test_require_and_unique(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    with pytest.raises(Exception, match="v is missing"):
        R.require(df, "v").collect()
    with pytest.raises(ValueError):
        stats.assert_unique(df, ["k"])


def test_variants_are_pruned(spark):
    docs = spark.createDataFrame([("著衣持缽而行",)], "content string")
    out = expand.expansions(spark, "著衣持鉢而", {"著": "着", "鉢": "缽,盋"}, docs, segment=3)
    assert sorted(r.spelling for r in out.collect()) == ["著衣持缽而"]


def test_words():
    assert expand.longest_match(frozenset(["長阿含", "阿含經"]), "長阿含經序", 3) == ["長阿含", "經", "序"]
    assert expand.tag_scheme(["長阿含經", "序"]) == [("長", "B"), ("阿", "I"), ("含", "I"), ("經", "E"), ("序", "S")]
    assert [t for _, t in expand.tag_scheme(["一二三四五六"], "SBM")] == ["B", "M1", "M2", "M", "M", "E"]
    assert expand.feature_tags("長阿含", [frozenset(["阿含"])]) == [["O"], ["B"], ["E"]]


def test_visits_stream(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-02 01:00"]), "url": ["a", "a", "b"]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, url string").parquet(f"{tmp_path}/in")
    q = visits.write_counts(visits.daily_counts(stream, "ts", ["url"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert q.awaitTermination(60)
    streamed = {(str(r.day), r.url, r.visits) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(str(r.day), r.url, r.visits) for r in visits.daily_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", ["url"]).collect()}
    assert streamed == batch == {("2024-01-01", "a", 2), ("2024-01-02", "b", 1)}
    merged = visits.merge_counts(spark.createDataFrame([("a", 2)], "url string, visits long"), spark.createDataFrame([("a", 3)], "url string, visits long"), ["url"])
    assert merged.first().visits == 5


def _spread_rows(spark):
    rng = random.Random(6)
    left = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(60), i) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "b", None]), t, f"v{t}-{k}") for k, t in enumerate(rng.sample(range(60), 25))]
    return left, right, spark.createDataFrame(left, "g string, t int, n int"), spark.createDataFrame(right, "g string, t int, v string")


@pytest.mark.parametrize("most", [0, 1_000_000])
@pytest.mark.parametrize("forward", [False, True])
def test_as_of_of_a_group_that_spreads_over_ranges(spark, monkeypatch, most, forward):
    monkeypatch.setattr(R, "GROUP_ROWS", most)
    left, right, a, b = _spread_rows(spark)
    got = {r.n: r.v for r in R.as_of(a, b, ["g"], "t", "t", ["v"], forward).collect()}
    for g, t, n in left:
        fits = [x for x in right if x[0] == g and (x[1] >= t if forward else x[1] <= t)]
        assert got[n] == ((min if forward else max)(fits, key=lambda x: x[1])[2] if fits else None)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_carried_values_and_changes_over_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(R, "GROUP_ROWS", most)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x"]), i, rng.choice([None, None, "p", "q"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, n int, v string")
    filled = {r.n: r.f for r in R.fill_forward(frame, ["g"], ["n"], F.col("v"), "f").collect()}
    flags = {r.n: r.f for r in R.changed(frame, ["g"], ["n"], "v", "f").collect()}
    last, before = {}, {}
    for g, n, v in rows:
        last[g] = v if v is not None else last.get(g)
        assert filled[n] == last[g] and flags[n] == (g not in before or before[g] != v)
        before[g] = v
