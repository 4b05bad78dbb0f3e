"""The stored index against scans of the same texts, its plan, and the replacement of a canon."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stemma.operators import endpoints as E, expand, kwic, phrase_index as P, search as S
from stemma.plans import qlang

rng = random.Random(11)
SCHEMA = "n long, canon string, content string, plain string, year int"


def say(letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


ROWS = [(i, rng.choice(["T", "X", "01", None, "a b/c"]), say("abab c阿含😀", 60), say("ab", 20), i % 7) for i in range(150)] + [(900, "T", "", None, 1), (901, "T", None, "a", 1), (902, "X", "a", "", 1)]
QUERIES = ['"ab"', '"aba"', '"a"', '"阿含"', '"含😀"', '"abab"', '"ab" "阿"', '"ab" | "含 "', '!"ab"', '"c" !"ab"', '"ab" -"aba"', '"a b c 阿"/3', '"ab阿"/0.6', '"ab" NEAR/4 "c"', '"b" NEAR/9 "bab"', '"ab" (!"阿" | "c")']


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return P.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i", "n", ["content", "plain"], "canon", buckets=8)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("query", QUERIES)
def test_matches_of_a_scan(docs, index, query):
    scan = S.match(docs.fillna("", ["content"]), query, key="n").select("n", "term_hits")
    assert rows(index.match(query)) == rows(scan)
    within = S.match(docs.fillna("", ["content"]).where("canon = '01' or canon = 'X'"), query, key="n").select("n", "term_hits")
    assert rows(index.match(query, canons=["X", "01"])) == rows(within)


def test_places_contexts_and_fields(docs, index):
    assert rows(index.occurrences("ab,阿", 5)) == rows(kwic.occurrences(docs, "n", "content", "ab,阿", 5))
    assert rows(index.occurrences("ab", 5, field="plain")) == rows(kwic.occurrences(docs, "n", "plain", "ab", 5))
    assert rows(index.occurrences("ab", 5, keys=[3, 4])) == rows(kwic.occurrences(docs.where("n in (3, 4)"), "n", "content", "ab", 5))
    assert rows(index.near(["ab", "c"], [3]).select("n", "p1", "p2")) == rows(kwic.near(docs, "n", "content", ["ab", "c"], [3]).select("n", "p1", "p2"))
    found, places = index.places(["aba", "a"])
    for r in found.select("n", *[c.alias(q) for q, c in places.items()]).collect():
        text = next(x[2] for x in ROWS if x[0] == r.n)
        assert r.aba == [m.start() + 1 for m in re.finditer("(?=aba)", text)] and r.a == [i + 1 for i, c in enumerate(text) if c == "a"]


def test_composed_answers(docs, index):
    for query, order in (('"ab" "c"', "term_hits"), ('"ab" -"aba"', "year-,term_hits"), ('"ab" NEAR/4 "c"', "year")):
        one = index.all_in_one(query, ["year"], order=order, start=1, rows=6, around=4, facets=["year"])
        two = E.all_in_one(docs, "n", "content", query, order=order, start=1, rows=6, around=4, facets=["year"])
        assert [tuple(r) for r in one.results.select("n", "term_hits", "year", "kwics").collect()] == [tuple(r) for r in two.results.select("n", "term_hits", "year", "kwics").collect()]
        assert rows(one.total) == rows(two.total) and rows(one.facets) == rows(two.facets)
    spellings = ["ab", "cb", "阿", "zz"]
    assert rows(index.spelling_hits(spellings)) == rows(expand.spelling_hits(docs.fillna("", ["content"]), "content", spellings))
    assert [tuple(r) for r in index.read(3, 2, 4).collect()] == [(3, ROWS[3][2][2:6])]


def test_only_the_query_s_buckets_are_read(spark, index):
    wanted = {r[0] for r in spark.createDataFrame([("ab",), ("含😀",)], "p string").select(P._bucket(F.col("p"), 8)).collect()}
    read = index.postings(["ab", "含😀"])
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and {int(re.search(r"bucket=(\d+)", f)[1]) for f in files} <= wanted
    assert {re.search(r"field=(\w+)", f)[1] for f in files} == {"content"}
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[In\(pair", plan) and "content" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_a_canon_is_replaced(spark, docs, tmp_path):
    path = f"file://{tmp_path}/i"
    before = P.build(docs, path, "n", ["content"], "canon", buckets=4)
    newer = spark.createDataFrame([(500, "T", "abc 新", "x", 1), (501, "new/one", "ab", "x", 2), (502, None, "c新", "x", 2)], SCHEMA)
    after = P.build(newer, path, "n", ["content"], "canon", buckets=4)
    gone = [r[0] for r in ROWS if r[1] in ("T", None)]
    left = docs.where(~F.col("n").isin(gone)).unionByName(newer).fillna("", ["content"])
    for query in ('"ab"', '"新"', '!"ab"'):
        assert rows(after.match(query)) == rows(S.match(left, query).select("n", "term_hits"))
    assert {r.n for r in after.texts().collect()} == {r.n for r in left.collect()}
    generations = {g for _, g in after.live}
    folders = {str(p).split("generation=")[1] for p in tmp_path.glob("i/*/*/generation=*")}
    assert folders == generations and len(generations) == 2 and len({g for _, g in before.live}) == 1
    with pytest.raises(ValueError):
        P.build(newer, path, "n", ["content"], "canon", buckets=5)
    with pytest.raises(ValueError):
        P.TextIndex(spark, f"file://{tmp_path}/none")
    with pytest.raises(qlang.QueryError):
        after.match('"a" | "b" NEAR/2 "c"')


def test_empty_index(spark, docs, tmp_path):
    index = P.build(docs.limit(0), f"file://{tmp_path}/i", "n", ["content"], "canon")
    assert index.match('"ab"').count() == 0 and index.match('!"ab"').count() == 0 and index.occurrences("ab").count() == 0
