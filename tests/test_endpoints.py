"""Composed searches, and operators at sizes that a plan must bear."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import endpoints as E, expand, kwic, relations as R, search as S, similar
from stemma.plans.qlang import QueryError


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "老子曰道可道非常道"), (2, "道在老子之前有道"), (3, "增上意樂是意樂"), (4, "無"), (5, None)]
    return S.searchable(spark.createDataFrame(rows, "id long, text string"))


def test_near_counts_tuples_and_drops_what_is_too_far(docs):
    got = {r.id: r.term_hits for r in S.match(docs, '"老子" NEAR/3 "道"', key="id").collect()}
    assert got == {1: 2, 2: 2}
    assert S.match(docs, '"老子" NEAR/0 "非"', key="id").count() == 0
    with pytest.raises(QueryError):
        S.match(docs, '"老子" NEAR/3 "道"')
    with pytest.raises(QueryError):
        S.match(docs, '"無" | "老子" NEAR/3 "道"', key="id")


def test_all_in_one_pages_after_exclusion(docs):
    found = E.all_in_one(docs, "id", "content", '"意樂" -"增上意樂"', facets=["text"])
    assert [(r.id, r.term_hits, [k.pos for k in r.kwics]) for r in found.results.collect()] == [(3, 1, [6])]
    assert found.total.first().num_found == 1 and found.facets.count() == 1
    assert E.all_in_one(docs, "id", "content", '"意樂" -"增上意樂"', start=1).results.count() == 0


def test_answers_are_kept_by_release_and_caller(docs):
    cache, made = E.ResultCache("r1", most=1), []
    ask = lambda caller: cache.fetch({"q": "道"}, caller, lambda: made.append(caller) or S.match(docs, "道"))
    assert [ask("a").count(), ask("a").count(), ask("b").count(), ask("a").count()] == [2, 2, 2, 2] and made == ["a", "b", "a"]


def test_parameters():
    with pytest.raises(QueryError):
        E.equal_to({"juan": 1}, {"juan": "juan"}, {"juan": "work"})


def test_a_long_query_in_the_other_script(docs):
    with pytest.raises(QueryError):
        E.simplified(docs, "content", "道" * 51, {})
    assert E.simplified(docs, "content", "道", {}).first().num_found == 0


def test_rendered_alignment():
    assert similar.rendered("道可道", "非道可道經") == "非<mark>道可道</mark>經"
    assert similar.rendered("abcdef", "xabzdefc") == "x<mark>ab<del>z</del>def</mark><em>c</em>"
    assert similar.rendered("ab", "xy") == "xy" and similar.rendered("ab", "") == ""


def test_segmentation_by_join_equals_that_by_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "著衣持鉢而行"), (2, ""), (3, None), (4, "行")], "k int, t string")
    words = spark.createDataFrame([("著衣",), ("持鉢",), ("持鉢而",), ("行",)], "w string")
    run = lambda: sorted((r.k, r.segmented) for r in expand.segment(docs, F.col("t"), words, "k").collect())
    first = run()
    monkeypatch.setattr(expand, "MOST_WORDS", 1)
    assert run() == first == [(1, "著衣/持鉢而/行"), (2, ""), (3, None), (4, "行")]


def test_a_text_with_many_places(spark):
    docs = spark.createDataFrame([(1, "ab " * 100_000)], "k int, t string")
    assert kwic.occurrences(docs, "k", "t", "ab", 3).agg(F.count(F.lit(1)), F.max("pos")).first()[:] == (100_000, 299_998)


def test_trees(spark):
    n = 1_200_000  # beyond the row limit of recursive SQL
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 50)).alias("parent"), F.lit("x").alias("label"))
    out = R.paths(nodes).agg(F.count(F.lit(1)), F.max("depth"), F.max(F.length("path"))).first()
    assert out[:] == (n, 4, 9)
    assert R.subtree(nodes, 1).count() == 1 + 50 + 2500 + 125_000
    deep = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("x").alias("label"))
    assert R.paths(deep).agg(F.max("depth")).first()[0] == 299
    circle = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id long, parent long, label string")
    assert [r.id for r in R.paths(circle).collect()] == [3]


def test_outline_of_any_depth(spark):
    rows = spark.createDataFrame([("w", i, d) for i, d in enumerate([*range(1, 13), 12, 3, 1, 2])], "w string, i int, d int")
    got = [r.number for r in R.outline(rows, "w", "i", "d").orderBy("i").collect()]
    assert got[11:] == [".".join("1" * 12), ".".join(["1"] * 11 + ["2"]), "1.1.2", "2", "2.1"]
