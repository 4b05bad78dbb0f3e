"""Notes with their references, golden for each kind, and rare characters in scope and both ways."""

import json
import random

from stemma.operators import glyphs as G
from stemma.sources import tei

CHARS = """<charDecl>
<char xml:id="C1"><charProp><localName>composition</localName><value>[金*本]</value></charProp><mapping type="unicode">U+9262</mapping></char>
<char xml:id="C2"><charProp><localName>composition</localName><value>[口*兮]</value></charProp><mapping type="normal_unicode">U+5FD8</mapping></char>
<char xml:id="C3"><charProp><localName>composition</localName><value>[a/b]</value></charProp><charProp><localName>normalized form</localName><value>安</value></charProp></char>
<char xml:id="C4"><charProp><localName>composition</localName><value>[x+y]</value></charProp></char>
<char xml:id="SD1"><charProp><localName>Romanized form in Unicode transcription</localName><value>oṃ</value></charProp></char>
<char xml:id="SD2"><charProp><localName>Character in the Siddham font</localName><value>S</value></charProp><charProp><localName>Romanized form in Unicode transcription</localName><value>hūṃ</value></charProp></char>
<char xml:id="RJ1"/><char xml:id="C5"/></charDecl>"""


def doc(body, attributes=""):
    return f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>{CHARS}</teiHeader><text{attributes}><body>{body}</body></text></TEI>'


def g(*ids):
    return "".join(f'<g ref="#{i}"/>' for i in ids)


def test_glyphs_in_scope():
    every = ("C1", "C2", "C3", "C4", "C5", "SD1", "SD2", "RJ1", "none")
    rows = tei.SearchText(doc(f"<p>{g(*every)}</p><p><term behaviour='no-norm'>{g('C2', 'C3')}<term>{g('C2')}</term></term>{g('C3')}</p>")).rows()
    assert rows[0][1] == "鉢忘安[x+y][C5]oṃS◇◇" + "[口*兮][a/b]忘安"
    assert tei.SearchText(doc(f"<p>{g('C1', 'C2')}</p>", ' behaviour="no-norm"')).rows()[0][1] == "鉢[口*兮]"
    assert tei.SearchText(doc(f"<p>{g('C2', 'C4')}</p>"), {"C2": "Z", "C4": {"uni": "Y"}}).rows()[0][1] == "ZY"


def noted(body):
    return [(j, page, json.loads(notes), missing) for j, page, notes, missing in tei.NotedHtml(doc(body)).rows()]


def ids(page):
    return [(x["id"], x["kind"], x["text"], x["refs"]) for x in page[2]]


def test_original_and_modified_notes():
    (page,) = noted('<p>a<note n="0001001" type="orig">old</note><note n="0001001" type="mod">new</note>b<note n="0001002" type="orig" subtype="ke">k</note>c<note n="0001003" type="orig">two parts</note><note n="0001003a" type="mod">one</note><note n="0001003b" type="mod">two</note></p>')
    assert ids(page) == [("n0001001", "mod", "new", ["ref-n0001001-1"]), ("n0001002", "orig", "k", ["ref-n0001002-1"]), ("n0001003a", "mod", "one", ["ref-n0001003a-1"]), ("n0001003b", "mod", "two", ["ref-n0001003b-1"])]
    assert page[1].startswith('<p class="p">a<a class="noteAnchor" id="ref-n0001001-1" href="#n0001001"></a>b<a class="noteAnchor" id="ref-n0001002-1" href="#n0001002" data-label="科02"></a>c')
    assert page[1].endswith('<div class="note" id="n0001003b">two<a class="back" href="#ref-n0001003b-1"></a></div>')


def test_stars_refer_once_more_and_are_counted():
    body = '<milestone unit="juan" n="1"/><p>a<note n="0001007" type="orig">x&lt;y</note>b<app type="star" corresp="#0001007"><lem>c</lem><rdg>d</rdg></app>e<note type="star" corresp="#0001007"/></p><milestone unit="juan" n="2"/><p><note type="star" corresp="#0001007"/>f<note type="star" corresp="#0009009"/></p>'
    one, two = noted(body)
    assert ids(one) == [("n0001007", "orig", "x<y", ["ref-n0001007-1", "ref-n0001007-2", "ref-n0001007-3"])] and one[3] == ""
    assert 'b<a class="noteAnchor star" id="ref-n0001007-2" href="#n0001007" data-star-no="7-1"></a>ce<a class="noteAnchor star"' in one[1]
    assert '<div class="note" id="n0001007">x&lt;y<a class="back" href="#ref-n0001007-1"></a><a class="back" href="#ref-n0001007-2"></a>' in one[1]
    assert ids(two) == [("n0001007", "orig", "x<y", ["ref-n0001007-1"])] and two[3] == "0009009" and 'data-star-no="7-3"' in two[1]


def test_added_notes_and_parallels():
    body = f'<p>a<note n="0001a01" type="add">see {g("C1")}</note><app n="0001a01"><lem>b<note type="cf1">T01n0001p0001a01</note><note type="cf2">other</note></lem></app><note type="add">second</note></p>'
    (page,) = noted(body)
    assert ids(page) == [("a1-1", "add", "see 鉢(cf. T01n0001p0001a01; other)", ["ref-a1-1-1"]), ("a1-2", "add", "second", ["ref-a1-2-1"])]
    assert 'a<a class="noteAnchor add" id="ref-a1-1-1" href="#a1-1"></a>b<a class="noteAnchor add"' in page[1]


def test_notes_that_are_text_or_hidden():
    body = '<p>a<note place="inline">小<note place="interlinear">旁</note></note><note type="authorial">own</note><note place="inline2">雙</note><note n="1" type="orig" rend="hide">h</note><note type="rest">r</note><note type="equivalent">e</note><note type="cf1">c</note><note place="foot" n="0001002">plain<note place="inline">in</note><app><lem>L</lem><rdg>R</rdg></app><unclear/></note></p>'
    (page,) = noted(body)
    assert ids(page) == [("n0001002", "orig", "plain(in)L▆", ["ref-n0001002-1"])]
    assert tei.SearchText(doc(body)).rows()[0][1] == "a(小(旁))own(雙)"


def test_noted_html_of_files(spark):
    files = spark.createDataFrame([("f", doc('<p>a<note n="1" type="orig">x</note></p>')), ("g", None)], "file string, content string")
    (row,) = tei.transform(files, "noted_html").collect()
    assert (row.file, row.juan, json.loads(row.notes)[0]["text"], row.missing) == ("f", 1, "x", "")


def test_glyphs_both_ways_on_a_large_table(spark):
    rng = random.Random(2)
    table = [(f"[{chr(0x4E00 + i % 150)}*{chr(0x5000 + i // 150)}]", chr(0xF0000 + i)) for i in range(10_000)]
    glyphs = spark.createDataFrame(table, "composition string, private string")
    say = lambda: "".join(rng.choice([rng.choice(table)[0], "字", "a", "[unknown]"]) for _ in range(rng.randrange(30)))
    rows = [(i, say()) for i in range(400)] + [(900, None), (901, ""), (None, table[5][0])]
    texts = spark.createDataFrame(rows, "n long, t string")
    private = G.to_private(texts, "n", "t", glyphs)
    known = dict(table)
    for r in private.collect():
        text = dict(rows)[r.n]
        if text is not None:
            for composition, c in known.items():
                if composition in text:
                    text = text.replace(composition, c)
        assert r.t == text
    back = G.to_composition(private, "n", "t", glyphs)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
