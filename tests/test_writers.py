"""DocuXML with overlapping tags, texts of several editions, styles and tags."""

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.sources import docuxml as D, tei


def test_golden_nesting():
    spans = [(0, 4, "a", [("id", '1"')]), (2, 6, "b", []), (2, 3, "c", []), (6, 6, "mark", []), (9, 12, "x", []), (5, 99, "y", [])]
    assert D.nested("ab<&ef\x00gh", spans) == '<a id=\'1"\'>ab<b><c>&lt;</c>&amp;</b></a><b>e<y>f</y></b><y><mark/>gh</y><x/>'


def test_every_character_keeps_its_tags():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab<&字") for _ in range(rng.randrange(15)))
        spans = [(a, a + rng.randrange(8), f"t{k}", []) for k in range(rng.randrange(7)) for a in [rng.randrange(12)]]
        root = ET.fromstring(f"<r>{D.nested(text, spans)}</r>")
        got = []

        def visit(e, tags):
            got.extend((c, tags) for c in e.text or "")
            for x in e:
                visit(x, tags | {x.tag})
                got.extend((c, tags) for c in x.tail or "")

        visit(root, frozenset())
        assert got == [(c, frozenset(t for a, b, t, _ in spans if a <= i < b)) for i, c in enumerate(text)]


def test_documents_and_exports(spark):
    rows = [("w1", 1, "如是我聞", [(0, 2, "name", {"key": "A<1"})], "t&u"), ("w1", 2, "一時", [], None), ("w2", 1, None, None, "x")]
    texts = spark.createDataFrame(rows, f"work string, juan int, text string, spans {D.SPANS}, title string").withColumn("file", F.concat_ws("_", "work", "juan"))
    made = D.documents(texts, "file", "text", "spans", ["title", "work"]).withColumn("work", F.substring_index("file", "_", 1))
    out = {r.work: r.xml for r in D.exports(made, "work", ["file"]).collect()}
    assert out["w1"] == (
        '<?xml version="1.0" encoding="UTF-8"?><ThdlPrototypeExport><documents><document filename="w1_1"><title>t&amp;u</title><work>w1</work><doc_content><name key="A&lt;1">如是</name>我聞</doc_content></document>'
        '<document filename="w1_2"><work>w1</work><doc_content>一時</doc_content></document></documents></ThdlPrototypeExport>'
    )
    assert all(ET.fromstring(x) is not None for x in out.values())


def test_two_editions_of_one_file(spark):
    body = (
        '<milestone unit="juan" n="1"/><lb n="0001a01" ed="T"/><lb n="0009a05" ed="R"/>如<app><lem wit="#T">是<lb n="0001a02" ed="T"/>我</lem><rdg wit="#R #Q">此<lb n="0009a06" ed="R"/></rdg><rdg wit="#Q">x</rdg></app>聞'
        '<app><lem>一<app><lem>a</lem><rdg wit="#R">b</rdg></app></lem><rdg wit="#Q">q</rdg></app><note place="inline">小&lt;</note><milestone unit="juan" n="2"/><lb n="0002a01" ed="T"/><lb n="0010a01" ed="R" type="old"/>末'
    )
    xml = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>{body}</p></body></text></TEI>'
    got = {(r.juan, r.edition): r.html for r in tei.transform(spark.createDataFrame([("f", xml)], "file string, content string"), "editions").collect()}
    assert got == {
        (1, "T"): '<a id="lb0001a01"></a>如是<a id="lb0001a02"></a>我聞一a(小&lt;)', (1, "R"): '<a id="lb0009a05"></a>如此<a id="lb0009a06"></a>聞一b(小&lt;)',
        (2, "T"): '<a id="lb0002a01"></a>末', (2, "R"): "末",
    }
    named = tei.Editions(xml, witnesses={"T": "Q"}).rows()
    assert named[1][2] == '<a id="lb0001a01"></a>如此聞q(小&lt;)'


def test_styles_and_tags(spark):
    styles = ["margin-left:2em", "text-indent: -1em", "text-indent:3em;", "margin-left:1em; text-indent:-2em", "margin-left:1.5em;text-indent:0em", "color:red", "margin-left:1em;color:red", "", None]
    frame = spark.createDataFrame([(s,) for s in styles], "s string")
    assert [r.c for r in frame.select(T.style_class("s").alias("c")).collect()] == ["m2", "j1", "i3", "m1_j2", "m1_i0", None, None, None, None]
    tags = frame.limit(1).select(T.html_tag("a", {"href": F.lit('x"<'), "id": F.lit(None).cast("string"), "n": F.lit(3)}, T.escaped_html(F.lit("a<b"))).alias("x"), T.html_tag("br", {}).alias("y")).first()
    assert tuple(tags) == ('<a href="x&quot;&lt;" n="3">a&lt;b</a>', "<br/>")
