"""Each registered query against its SQL on the smallest tables."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import stemma.endpoint_queries  # noqa: F401
from stemma.operators.versions import units
from stemma.queries import QUERIES, SQL, TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values])


def test_the_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 130"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        other = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(other.columns)
        assert rows(df.columns, got) == rows(other.columns, other.fetchall())
    else:
        assert got


def test_version_diff_compares_whole_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [("c", 0, f"{long} the end"), ("c", 1, f"{long} the end"), ("c", 2, f"{long} the\nlast the"), ("d", 2, "the short"), ("d", 4, None)]
    spark.createDataFrame(rows, "conv_id string, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv, turn, old in rows:
        if turn % 2 == 0 and old is not None:
            new = old.replace("the", "a") + "."
            a, b = units(old), units(new)
            row = [0] * (len(b) + 1)
            for x in a:  # weight of the longest common subsequence of units
                before = row[:]
                for j, y in enumerate(b):
                    row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
            want[f"{conv}-{turn}"] = (old, new, len(b) - row[-1], len(a) - row[-1])
    got = {}
    for r in QUERIES["version_diff"](spark, str(tmp_path)).collect():
        without = lambda tag: re.sub(r"</?(ins|del)>", "", re.sub(rf"(?s)<{tag}>.*?</{tag}>", "", r.html))
        parts = lambda tag: [x for s in re.findall(rf"(?s)<{tag}>(.*?)</{tag}>", r.html) for x in units(s)]
        got[r.k] = (without("ins"), without("del"), len(parts("ins")), len(parts("del")))
        assert (r.ins_chars, r.del_chars) == (sum(map(len, parts("ins"))), sum(map(len, parts("del"))))
    assert got == want
