import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("n, said", [(0, "零"), (10, "十"), (20, "二十"), (101, "一百零一"), (110, "一百十"), (1001, "一千零一"), (7, "七"), (345, "三百四十五")])
def test_numerals(spark, n, said):
    assert value(spark, T.int_to_zht(F.lit(n))) == said


@pytest.mark.parametrize("s, out", [("1", "0001"), ("150A", "0150A"), ("974C", "0974C"), ("_1579", "1579")])
def test_work_number(spark, s, out):
    assert value(spark, T.work_number(F.lit(s))) == out


@pytest.mark.parametrize("page, col, line, out", [("67", "a", "13", "0067a13"), ("a1", None, None, "a001a01"), ("386", None, None, "0386a01")])
def test_line_id(spark, page, col, line, out):
    assert value(spark, T.line_id(F.lit(page), F.lit(col), F.lit(line))) == out


@pytest.mark.parametrize(
    "s, kind, fields",
    [
        ("T01n0001_p0066c25", None, None),
        ("T01n0001_p0066c25".replace("_p", "_p"), None, None),
        ("CORPUS, T01, no. 1, p. 67, a13", "cited", ("T01", "1", "67", "a", "13")),
        ("CORPUS 2019.Q2, T01, no. 1, p. 1a6", "cited", ("T01", "1", "1", "a", "6")),
        ("CORPUS, T30, no. 1579, pp. 279a7-280b26", "cited", ("T30", "1579", "279", "a", "7")),
        ("T51, no. 2087, pp. 868-888", "paper", ("T51", "2087", "868", None, None)),
        ("T46, no. 1911, p. 18c", "paper", ("T46", "1911", "18", "c", None)),
        ("《大正藏》冊19，第974C 號，頁386", "volume page", ("19", "974C", "386", None, None)),
        ("《續藏經》冊142，頁1003b", "sequel", ("142", None, "1003", "b", None)),
        ("R130, p. 861b7", "sequel page", ("130", None, "861", "b", "7")),
        ("R130", "sequel page", ("130", None, None, None, None)),
    ],
)
def test_citations(spark, s, kind, fields):
    got = value(spark, T.parse_citation(F.lit(s)))
    if s.startswith("T01n"):
        assert got.kind == "linehead" and (got.vol, got.work, got.page, got.col, got.line) == ("T01", "0001_", "0066", "c", "25")
    else:
        assert (got.kind, (got.vol, got.work, got.page, got.col, got.line)) == (kind, fields)


def test_punctuation(spark):
    assert value(spark, T.remove_puncs(F.lit("如是。我(聞)1 a,b"))) == "如是我聞 ab"
    assert value(spark, T.ends_with_punc(F.lit("如是。"))) and not value(spark, T.ends_with_punc(F.lit("如是")))
    assert value(spark, T.offset_map(F.lit("如，是。我"))) == [0, 2, 4]


def test_marks(spark):
    assert value(spark, T.mark_chars(F.lit("abcab"), "ab")) == "<mark>ab</mark>c<mark>ab</mark>"
    assert value(spark, T.mark_phrase(F.lit("如是，我聞"), "是我")) == "如<mark>是，我</mark>聞"
    note = "(" + "一二三四五六七八九十甲乙丙丁戊" + ")"
    assert value(spark, T.abridge_notes(F.lit("前" + note + "後"))) == "前(一二⋯中略11字⋯丁戊)後"
    assert value(spark, T.abridge_notes(F.lit("前(短)後"))) == "前(短)後"


def test_urls_and_labels(spark):
    assert value(spark, T.url_path(F.lit("http://x.org/v1.2/download/epub/a.epub"))) == "/download/epub"
    assert value(spark, T.referer_host(F.lit(None).cast("string"), F.lit("1.2.3.4"))) == "1.2.3.4"
    assert value(spark, T.year_label(F.lit(-5))) == "5 BCE" and value(spark, T.thousands(F.lit(1234567))) == "1,234,567"
    assert T.elapsed(3661) == "1 hour 1 minute 1 second" and value(spark, T.canon_of(F.lit("GA001"))) == "GA"
    assert value(spark, T.volume(F.lit("T"), F.lit("1"))) == "T01" and value(spark, T.volume(F.lit("GA"), F.lit("1"))) == "GA001"
    assert value(spark, T.pick_glyph(F.lit(""), F.lit("甲"), F.lit("乙"), F.lit("[a+b]"))) == "甲"
    counts = spark.range(1).select(*[c.alias(k) for k, c in T.counters(F.lit("如是 don't，Ānanda")).items()]).first()
    assert (counts.chars, counts.chars_no_spaces, counts.en_words, counts.cjk_chars) == (15, 14, 2, 2)
