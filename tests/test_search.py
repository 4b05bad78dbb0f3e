import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import kwic, search as S
from stemma.plans import qlang


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "舍利弗舍利子"), (2, "正直心，直心"), (3, "老子道德經"), (4, "增上意樂"), (5, "阿阿阿"), (6, "The End of the story.")]
    return S.searchable(spark.createDataFrame(rows, "id long, text string"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_parse():
    assert qlang.parse('"a b" | !"c"') == qlang.Or((qlang.Phrase("a b"), qlang.Not(qlang.Phrase("c"))))
    assert qlang.parse('"老子" NEAR/7 "道" NEAR/3 "經"') == qlang.Near(("老子", "道", "經"), (7, 3))
    assert qlang.parse('"舍利" -"舍利弗"') == qlang.Exclude("舍利", "舍利弗")
    assert qlang.parse(r'"say \"x\""') == qlang.Phrase('say "x"')
    assert qlang.parse('"abc"/0.5') == qlang.Quorum(("a", "b", "c"), 0.5)
    for bad in ("", '"舍利" -"弗"', '"a', '("a"', '"a" NEAR/3', '"。"'):
        with pytest.raises(qlang.QueryError):
            qlang.parse(bad)


def test_exclude(docs):
    found = {r.id: r.term_hits for r in S.match(docs, '"舍利" -"舍利弗"').collect()}
    assert found == {1: 1}
    assert {r.id: r.term_hits for r in S.match(docs, '"直心" -"正直心"').collect()} == {2: 1}
    suffix = kwic.excluding(kwic.occurrences(docs, "id", "content", "舍利"), after="弗")
    prefix = kwic.excluding(kwic.occurrences(docs, "id", "content", "直心"), before="正")
    assert [r.pos for r in suffix.collect()] == [4] and [r.pos for r in prefix.collect()] == [4]


def test_positions_overlap(docs):
    assert sorted(r.pos for r in kwic.occurrences(docs, "id", "content", "阿阿").collect()) == [1, 2]


def test_near(docs):
    found = kwic.near(docs, "id", "content", ["老子", "道"], [7])
    assert [(r.id, r.p1, r.p2) for r in found.collect()] == [(3, 1, 3)]
    inside = kwic.near(docs, "id", "content", ["意樂", "增上意樂"], [7])
    assert inside.count() == 1 and kwic.drop_contained(inside, ["意樂", "增上意樂"]).count() == 0
    shown = found.join(docs, "id").select(kwic.render_near(F.col("content"), [(F.col("p1"), 2), (F.col("p2"), 1)]).alias("h")).first().h
    assert shown == "<mark>老子</mark><mark>道</mark>"
    assert kwic.near(docs, "id", "content", ["老子", "無"], [7]).count() == 0


def test_context_with_punctuation(docs):
    found = kwic.occurrences(docs, "id", "content", "心直").join(docs.select("id", "text"), "id")
    shown = kwic.with_punctuation(F.col("text"), T.offset_map(F.col("text")), F.col("pos"), F.length("keyword"), 1)
    assert [r.s for r in found.select(shown.alias("s")).collect()] == ["直<mark>心，直</mark>心"]
    marked = kwic.occurrences(docs, "id", "content", "直", 1).select(kwic.marked().alias("s"))
    assert sorted(r.s for r in marked.collect()) == ["心<mark>直</mark>心", "正<mark>直</mark>心"]


def test_filters_order_page_and_envelope(spark, docs):
    found = S.match(docs, '"of the" | "阿"')
    assert ids(found) == [5, 6] and S.exists(docs, '"道德"') and not S.exists(docs, '"德道"')
    assert [r.id for r in S.page(S.order(found, "term_hits", ["id"]), 0, 1).collect()] == [5]
    text = S.envelope(found.select("id", "term_hits"), S.totals(found)).first().json
    assert '"num_found":2' in text and '"total_term_hits":4' in text
    with pytest.raises(qlang.QueryError):
        S.page(found, -1)
