import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from stemma.sources import markup, readers, sinks, tei

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><charDecl><char xml:id="CB1"><charProp><localName>composition</localName><value>[a+b]</value></charProp></char></charDecl></teiHeader>
<text><body><milestone unit="juan" n="1"/><lb n="0001a01"/><mulu level="1">序</mulu><head>經序</head><p>如是<g ref="#CB1"/>我聞<note place="inline">小注</note>。</p>
<lb n="0001a02"/><mulu level="2">一</mulu><p>一時<note n="0001001" place="foot">校勘</note>佛</p><milestone unit="juan" n="2"/><lb n="0002a01"/><mulu level="1">次</mulu><p>在<app><lem>舍</lem><rdg>捨</rdg></app>衛<unclear/></p></body></text></TEI>"""


def test_tei(spark):
    files = spark.createDataFrame([("f", XML)], "file string, content string")
    rows = lambda name: [tuple(r)[1:] for r in tei.transform(files, name).collect()]
    assert rows("search_text") == [(1, "經序如是[a+b]我聞(小注)。一時佛", "經序如是[a+b]我聞。一時佛"), (2, "在舍衛▆", "在舍衛▆")]
    assert [(j, lb, json.loads(n) if n else None) for j, lb, _, n in rows("lines")] == [(1, "0001a01", None), (1, "0001a02", {"0001001": "校勘"}), (2, "0002a01", None)]
    assert rows("contents") == [("1", None, "序", 1, "0001a01"), ("1.1", "1", "一", 1, "0001a02"), ("2", None, "次", 2, "0002a01")]
    assert rows("juan_ends") == [(1, "0001a01", "0001a02"), (2, "0002a01", "0002a01")]
    assert [(n[2], n[3], n[4]) for n in rows("notes")] == [("1", "inline", "小注"), ("0001001", "foot", "校勘")]
    assert rows("plain_text")[1] == (2, "在舍衛▆") and '<h2 class="head">經序</h2>' in rows("reading_html")[0][1]
    lines = tei.transform(files, "lines")
    assert [r.text for r in tei.text_for_diff(lines).orderBy("lb").collect()] == ["經序如是a+b我聞小注", "一時佛", "在舍衛▆"]
    assert [r.html for r in tei.concordance_html(lines).orderBy("juan").collect()][1] == '<a id="lb0002a01"></a>在舍衛▆'
    assert [r.text for r in tei.index_text(tei.transform(files, "search_text")).orderBy("juan").collect()] == ["經序如是a+b我聞小注一時佛", "在舍衛▆"]
    page = tei.download_page(tei.transform(files, "reading_html"), spark.createDataFrame([("f", "a<b")], "file string, title string")).orderBy("juan").first().html
    assert "<title>a&lt;b</title>" in page and '<h2 class="head">經序</h2>' in page
    assert tei.catalog('<c><e n="a" label="A"><e label="B" work="T1"/></e></c>') == [("a", None, "A", None, "001"), ("a.001", "a", "B", "T1", "001")]


def test_readers(spark, tmp_path):
    (tmp_path / "T" / "T01").mkdir(parents=True)
    (tmp_path / "T" / "T01" / "T01n0001.xml").write_text(XML)
    assert [tuple(r)[1:4] for r in readers.corpus_files(spark, str(tmp_path)).collect()] == [("T", "T01", "T01n0001")]
    (tmp_path / "kv.txt").write_text("a=b=c\nno\n")
    assert [tuple(r) for r in readers.key_values(spark, str(tmp_path / "kv.txt")).collect()] == [("a", "b=c")]
    (tmp_path / "c.yml").write_text("# x\nT: '大正藏'\nX: 續藏經\n")
    assert [tuple(r) for r in readers.flat_yaml(spark, str(tmp_path / "c.yml")).collect()] == [("T", "大正藏"), ("X", "續藏經")]
    (tmp_path / "a.json").write_text(json.dumps({"T0001": {"title": "長阿含經", "juans": 22, "contributors": [{"id": "A1", "name": "x"}]}}))
    assert [(r.work, r.title, r.juans, r.contributors[0].id) for r in readers.authority(spark, str(tmp_path / "a.json")).collect()] == [("T0001", "長阿含經", 22, "A1")]
    log = '<h2>T0001, 1</h2>\nT01n0001_p0001a01║如<span class="ins">是是</span><br>\nT01n0001_p0001a02║<span class="del">我</span><br>'
    (tmp_path / "2024.html").write_text(log)
    assert [(r.ver, r.work, r.juan, r.lb, r.ins_chars, r.del_chars) for r in readers.change_log(spark, str(tmp_path / "2024.html")).collect()] == [
        ("2024", "T0001", 1, "T01n0001_p0001a01", 2, 0), ("2024", "T0001", 1, "T01n0001_p0001a02", 0, 1)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "# c\ntext")
    assert [r.content for r in readers.zipped_texts(spark, str(tmp_path / "z.zip")).collect()] == ["text"]
    (tmp_path / "p.xml").write_text('<l><person xml:id="A1"><persName type="regular_name" xml:lang="zho-Hant">玄奘</persName><persName type="alias">三藏</persName></person></l>')
    assert [(r.id, r.name, r.aliases) for r in readers.persons(spark, str(tmp_path / "p.xml")).collect()] == [("A1", "玄奘", ["三藏"])]
    raw = b"T01  T0001  " + struct.pack("<H", 3) + struct.pack(">I", 70000) + b"0067" + b"c" + bytes([25])
    got = readers.decode_positions(spark.createDataFrame([(bytearray(raw),)], "b binary"), "b").first()
    assert (got.vol, got.work, got.juan, got.offset, got.page, got.col, got.line) == ("T01", "T0001", 3, 70000, "0067", "c", 25)


def test_archives_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([("T1", "b.txt", "二", 2), ("T1", "a.txt", None, 3), ("X1", "c.txt", "三", 4), (None, "d", "x", 1)], "work string, name string, text string, n int")
    out = {r.key: r.files for r in sinks.zip_per_key(df, "work", "name", "text", f"file://{tmp_path}/zips").collect()}
    assert out == {"T1": 2, "X1": 1}
    with zipfile.ZipFile(tmp_path / "zips" / "T1.zip") as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt").decode() == "二"
    sinks.statistics(df, ["n"], ["work", "name"], f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats/total").first().n == 10 and spark.read.csv(f"{tmp_path}/stats/work", header=True).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("T", "a", 1), ("X", "b", 2)], "canon string, text string, n int")
    assert sinks.as_json(df, "f").orderBy("json").first().json == 'f({"canon":"T","text":"a","n":1})'
    sinks.replace(df, f"{tmp_path}/t", ["canon"])
    sinks.replace(spark.createDataFrame([("X", "c", 3)], df.schema), f"{tmp_path}/t", ["canon"])
    assert sorted((r.canon, r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("T", 1), ("X", 3)]
    more = sinks.insert_new(df, spark.createDataFrame([("X", "z", 9), ("Y", "q", 5), ("Y", "p", 4)], df.schema), "canon", "n")
    assert sorted((r.canon, r.n) for r in more.collect()) == [("T", 1), ("X", 2), ("Y", 4)]
    sinks.csv(df, f"{tmp_path}/new")
    sinks.csv(df, f"{tmp_path}/old")
    sinks.publish(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/old")
    assert spark.read.csv(f"{tmp_path}/old", header=True).count() == 2
    assert sinks.listing(df.withColumn("v", F.lit("1")), "v", ["n"], "text").first().text == "# 1\na\nb"
    works = spark.createDataFrame([("T0001", "題", "譯", "T", None), ("T0002", "x", "y", "T", "T0001")], "n string, title string, byline string, canon string, alt string")
    assert [r.primary_id for r in sinks.metadata(works, spark.createDataFrame([("T", "大正藏")], "id2 string, name string")).collect()] == ["T0001"]
    sinks.text_per_key(df, ["canon"], "text", f"{tmp_path}/texts")
    sinks.xml_docset(df, f"{tmp_path}/docset")
    assert spark.read.text(f"{tmp_path}/texts").count() == 2
    tree = {r.canon: r.json for r in sinks.tree_json(df, ["canon", "text"], ["n"]).collect()}
    assert tree["T"] == '{"canon":"T","items":[{"text":"a","items":[{"n":1}]}]}'


def test_html(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body><p>a &amp; <b>b</b></p><!-- no --><p>c</p></body></html>"
    assert spark.range(1).select(markup.html_text(F.lit(page)).alias("t")).first().t == "T\na & b\nc"
