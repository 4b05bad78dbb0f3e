import random

import pytest
from pyspark.sql import functions as F

import stemma.endpoint_queries  # noqa: F401
from stemma.operators import catalog as C, relations as R
from stemma.plans.qlang import QueryError
from stemma.queries import QUERIES

WORKS = [
    ("T0001", "T01", "長阿含經", "佛陀耶舍", "佛陀耶舍(A000001)", "後秦", 384, 417, None, "u1", 22, "譯"),
    ("T0220", "T05..T07", "大般若經", "玄奘", "玄奘(A000294)", "唐", 618, 907, None, "u2", 600, ""),
    ("T0150A", "T02", "七處三觀經", "安世高", "安世高(A1)", "東漢", 25, 220, "T0001+T01n0002_p0001a01", "u3", 1, None),
]
SCHEMA = "n string, vol string, title string, creators string, creators_with_id string, time_dynasty string, time_from int, time_to int, alt string, uuid string, juan int, byline string"


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(WORKS, SCHEMA)


def found(df):
    return [r.n for r in df.collect()]


def test_finder(works):
    assert found(C.find_works(works, work="T0001", dynasty="唐")) == ["T0001"]
    assert found(C.find_works(works, creator_id="A000294")) == ["T0220"]
    assert found(C.find_works(works, canon="T", vol_start="T06", vol_end="T06")) == ["T0220"]
    assert found(C.find_works(works, time_start="700", time_end="800")) == [] and found(C.find_works(works, mode="overlap", time_start="700", time_end="800")) == ["T0220"]
    assert found(C.find_works(works, dynasty="唐,後秦")) == ["T0220", "T0001"]
    with pytest.raises(QueryError):
        C.find_works(works)


def test_look_up_and_children(spark, works):
    catalog = spark.createDataFrame([("root", "a", "T01 阿含部", None, "001"), ("a", "b", None, "T0001", "001"), ("a", "c", "經 = 別名", None, "002")], "parent string, n string, label string, work string, sort string")
    toc = spark.createDataFrame([("1", "經序")], "n string, label string")
    kinds = lambda q: sorted((r.type, r.n) for r in C.look_up(q, catalog, works, toc).collect())
    assert kinds("T01") == [("catalog", "a")] and kinds("T01n0001") == [("work", "T0001")] and kinds("T02") == []
    assert kinds("經") == [("toc", "1"), ("work", "T0001"), ("work", "T0220")]
    assert [r.label for r in C.children(catalog, "a", works).collect()] == ["T0001 長阿含經 (22卷) 譯", "經 = 別名"]
    assert [(r.alt, r.linehead) for r in C.alternates(works).orderBy("place").collect()] == [("T0001", None), ("T0002", "T01n0002_p0001a01")]


def test_children_of_works_that_share_an_id(spark, works, tmp_path):
    catalog = spark.createDataFrame([("root", "a", None, "T0001", "1", "u1"), ("root", "b", None, "T0001", "2", "u4"), ("root", "c", "none", "T9", "3", None)], "parent string, n string, label string, work string, sort string, uuid string")
    several = works.unionByName(works.where("n = 'T0001'").withColumns({"title": F.lit("起世經"), "juan": F.lit(10), "uuid": F.lit("u4")}))
    first = "T0001 起世經 (10卷) 譯"
    assert [r.label for r in C.children(catalog, "root", several).collect()] == [first, first, "none"]
    assert [r.label for r in C.children(catalog, "root", several, "uuid", "uuid").collect()] == ["T0001 長阿含經 (22卷) 譯", first, "none"]
    rows = [(k, f"name {k}", f"Brand#{k}", "SMALL", 13) for k in (1234, 12340, 12341)]  # one id
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in QUERIES["catalog_children"](spark, str(tmp_path)).select("work", "label").collect()]
    assert sorted(got) == sorted(("T1234", f"T1234 name {k} (13卷) Brand#{k}") for k in (1234, 12340, 12341))


def test_resolve(spark):
    lines = spark.createDataFrame(
        [("T30", "T1579", 1, "0279", "a", "07", "T30n1579_p0279a07", 5), ("X01", "X0001", 2, "0001", "a", "01", "X01n0001_p0001a01", 9), ("T01", "T0001", 3, "0010", "a", "01", "T01n0001_p0010a01", 1)],
        "vol string, work string, juan int, page string, col string, line string, linehead string, ser_no int",
    )
    cites = spark.createDataFrame([("CORPUS, T30, no. 1579, p. 279a7",), ("R130, p. 861b7",), ("DA",), ("nothing",), ("《大正藏》冊01，第1 號，卷3",)], "s string")
    abbr = spark.createDataFrame([("DA", "CORPUS, T30, no. 1579, p. 279a7")], "abbr string, ref string")
    map_ = spark.createDataFrame([("R130.0861b07", "X01.0001a01")], "lb1 string, lb2 string")
    got = {r.s: r.linehead for r in C.resolve(cites, "s", lines, abbr, map_).collect()}
    assert got == {"CORPUS, T30, no. 1579, p. 279a7": "T30n1579_p0279a07", "R130, p. 861b7": "X01n0001_p0001a01", "DA": "T30n1579_p0279a07", "nothing": None, "《大正藏》冊01，第1 號，卷3": "T01n0001_p0010a01"}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_resolve_to_the_nearest_line(spark, monkeypatch, most):
    monkeypatch.setattr(R, "GROUP_ROWS", most)  # by ranges and by windows
    rng = random.Random(4)
    places = sorted({(rng.randrange(1, 40), rng.choice("abc"), rng.randrange(1, 29)) for _ in range(60)})
    lines = [("T01", "T0001", 1, f"{p:04d}", c, f"{n:02d}", f"T01n0001_p{p:04d}{c}{n:02d}", k) for k, (p, c, n) in enumerate(places)]
    asked = [(rng.randrange(0, 45), rng.choice("abc"), rng.randrange(1, 29)) for _ in range(80)] + [places[7]]
    cites = spark.createDataFrame([(f"T01, no. 1, p. {p}{c}{n}",) for p, c, n in asked] + [("T02, no. 2, p. 1a1",), ("nothing",)], "s string")
    frame = spark.createDataFrame(lines, "vol string, work string, juan int, page string, col string, line string, linehead string, ser_no int")
    got = {r.s: r.linehead for r in C.resolve(cites, "s", frame, nearest=True).collect()}
    for p, c, n in asked:
        at = f"{p:04d}{c}{n:02d}"
        behind = [x[6] for x in lines if x[3] + x[4] + x[5] >= at]
        assert got[f"T01, no. 1, p. {p}{c}{n}"] == (behind[0] if behind else lines[-1][6])
    assert got["T02, no. 2, p. 1a1"] is None and got["nothing"] is None


def test_many_lines_in_one_place(spark):
    """A place that 400 lines have and 400 citations name makes 400 rows, not a row for each pair."""
    lines = spark.range(400).selectExpr("'T01' vol", "'T0001' work", "cast(id % 5 as int) juan", "'0001' page", "'a' col", "'01' line", "if(id < 10, null, concat('T01n', 1000 - id)) linehead", "cast(id % 100 as int) ser_no")
    cites = spark.range(400).selectExpr("id", "'T01, no. 1, p. 1a1' s")
    found = C.resolve(cites, "s", lines)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    got = found.collect()
    assert len(got) == 400 and {(r.linehead, r.juan) for r in got} == {("T01n700", 0)}  # line 300; of those with number 0 the first by its name
    made = []
    for i in range(before, store.executionsList().size()):
        run = store.executionsList().apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())] if "Join" in node.name() else []
            made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert made and max(made) <= 400


def test_known_works(spark):
    works = spark.createDataFrame([("T1969A",), ("T0001",), ("T0150A",), ("T0150",)], "n string")
    asked = spark.createDataFrame([("T1969",), ("T0001",), ("T0150",), ("T0150A",), ("T9",), (None,)], "id string")
    assert {r.id: r.work for r in C.known_works(asked, "id", works).collect()} == {"T1969": "T1969A", "T0001": "T0001", "T0150": "T0150", "T0150A": "T0150A", "T9": None, None: None}


def test_glyphs_and_layers(spark):
    df = spark.createDataFrame([(1, "[a+b]與[c-d]。"), (2, "無")], "id int, t string")
    assert [r.g for r in df.orderBy("id").select(C.replace_glyphs(df, "t", {"[a+b]": "甲"}).alias("g")).collect()] == ["甲與[c-d]。", "無"]
    layers = spark.createDataFrame([(2, 0, "start", "P1", "無"), (2, 1, "end", "P1", ""), (1, 3, "start", "P2", "與")], "id int, position int, type string, entity string, name string")
    out = {r.id: (r.html, r.mismatches) for r in C.with_layers(df, layers, "id", "t").collect()}
    assert out[2] == ('<a class="start" data-key="P1"></a>無<a class="end" data-key="P1"></a>', []) and out[1][1] == ["P2: 與 is not at 3"]


def test_order_helpers(spark):
    halves = spark.createDataFrame([("T0220", 2, 1, "b"), ("T0220", 1, 1, "a")], "work string, file int, juan int, text string")
    assert C.stitch(halves, ["work", "juan"], ["file"], "text").first().text == "ab"
    marks = spark.createDataFrame([("#n1", 1), ("#n1", 2), ("#n2", 3)], "target string, pos int")
    assert [r.star for r in C.repeat_counter(marks, "target", ["pos"]).orderBy("pos").collect()] == [1, 2, 1]
    lbs = spark.createDataFrame([("f", 1, "R", "R1.1"), ("f", 2, "X", "X1.1"), ("f", 3, "X", "X1.2")], "file string, pos int, ed string, lb string")
    assert [tuple(r) for r in C.adjacent(lbs, ["file"], ["pos"], "ed", "lb", "R", "X").collect()] == [("R1.1", "X1.1")]
