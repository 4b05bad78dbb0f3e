"""Readers: every source has a schema of its own; none is inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

AUTHORITY = (
    "title string, juans int, byline string, type string, vol string, category string, dynasty string, time_from int, time_to int, alt string, "
    "contributors array<struct<id:string,name:string>>, places array<struct<id:string,name:string,long:double,lat:double>>"
)
VISITS = "url string, referer string, accessed_at date, count long"
DYNASTIES = "dynasty string, time_from int, time_to int"
LAYERS = "lb string, type string, tag string, position int, name string, key string"
STATS = "work string, chars long, chars_no_spaces long, cjk_chars long, en_words long, canon string, category string, alt string"


def corpus_files(spark: SparkSession, root: str, pattern: str = "*.xml", canons: str = r"^[A-Z]{1,2}$") -> DataFrame:
    """path, canon, vol, file, content of a corpus laid out as canon/vol/file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    named = files.select("path", part(-3).alias("canon"), part(-2).alias("vol"), F.regexp_replace(part(-1), r"\.[^.]+$", "").alias("file"), F.decode("content", "UTF-8").alias("content"))
    return named.where(F.col("canon").rlike(canons))


def authority(spark: SparkSession, path: str) -> DataFrame:
    """work and its record from files {work: {…}}; of a work in several files the last file's."""
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", f"map<string,struct<{_fields(AUTHORITY)}>>").alias("m"))
    rows = texts.select("file", F.explode("m").alias("work", "r"))
    return rows.groupBy("work").agg(F.max_by("r", "file").alias("r")).select("work", "r.*")


def _fields(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def persons(spark: SparkSession, path: str) -> DataFrame:
    """id, name, aliases from person records in XML; the name is the regular one in traditional characters."""
    schema = "`_xml:id` string, persName array<struct<_VALUE:string,`_type`:string,`_xml:lang`:string>>"
    rows = spark.read.format("xml").option("rowTag", "person").schema(schema).load(path)
    chosen = F.filter("persName", lambda n: (n["_type"] == "regular_name") & (n["_xml:lang"] == "zho-Hant"))
    other = F.filter("persName", lambda n: n["_type"] != "regular_name")
    return rows.select(F.col("`_xml:id`").alias("id"), F.get(chosen, F.lit(0))["_VALUE"].alias("name"), F.array_distinct(F.transform(other, lambda n: n["_VALUE"])).alias("aliases"))


def flat_yaml(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file of plain 'key: value' lines."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    strip = lambda c: F.regexp_replace(F.trim(c), "^['\"]|['\"]$", "")
    return lines.select(strip(F.regexp_extract("value", r"^([^:]+):", 1)).alias("key"), strip(F.regexp_extract("value", r"^[^:]+:(.*)$", 1)).alias("value"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines that are split at their first '='."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("=")))
    return lines.select(F.regexp_extract("value", "^(.*?)=", 1).alias("key"), F.regexp_extract("value", "^.*?=(.*)$", 1).alias("value"))


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """ver, work, juan, lb, html, ins_chars, del_chars of change-log pages.

    A page is a heading for each work and fascicle and lines 'linehead║html' below it; headings are carried on. A line
    that is neither, nor markup or blank, fails the query.
    """
    from ..operators.versions import tagged_chars

    pages = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1).alias("ver"), "value")
    lines = pages.select("ver", F.posexplode(F.split("value", r"\n|<br ?/?>")).alias("pos", "line"))
    head = F.regexp_extract("line", r"<h2>\s*(\S+?)[,_ ]+(\d+)\s*</h2>", 1)
    juan = F.regexp_extract("line", r"<h2>\s*(\S+?)[,_ ]+(\d+)\s*</h2>", 2)
    w = Window.partitionBy("ver").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumns({"work": F.last(F.nullif(head, F.lit("")), True).over(w), "juan": F.last(F.nullif(juan, F.lit("")), True).over(w).cast("int")})
    blank = F.trim(F.regexp_replace("line", "<[^>]*>", "")) == ""
    is_line, is_head = F.contains("line", F.lit("║")), F.contains("line", F.lit("<h"))
    checked = filled.where(F.assert_true(is_line | is_head | blank, F.concat(F.lit("unknown line: "), "line")).isNull())
    rows = checked.where(is_line).select("ver", "work", "juan", F.trim(F.substring_index("line", "║", 1)).alias("lb"), F.regexp_extract("line", "║(.*)$", 1).alias("html"))
    return rows.withColumns({"ins_chars": tagged_chars(F.regexp_replace("html", r'<span class="ins">(.*?)</span>', "<ins>$1</ins>"), "ins"), "del_chars": tagged_chars(F.regexp_replace("html", r'<span class="del">(.*?)</span>', "<del>$1</del>"), "del")})


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, entry, content of text entries in archives, without comment lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for entry in sorted(n for n in z.namelist() if n.endswith(".txt")):
                        lines = z.read(entry).decode("utf-8").splitlines()
                        out.append((name, entry, "\n".join(x for x in lines if not x.startswith("#"))))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "entry", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, entry string, content string")


def decode_positions(df: DataFrame, column: str) -> DataFrame:
    """Fixed records of 24 bytes: vol(5) work(7) juan(2) offset(4, big endian) page(4) col(1) line(1), as columns."""
    c = F.col(column)
    text = lambda a, n: F.rtrim(F.decode(F.substring(c, a, n), "UTF-8"))
    number = lambda a, n: F.conv(F.hex(F.substring(c, a, n)), 16, 10).cast("long")
    return df.select(
        *[x for x in df.columns if x != column], text(1, 5).alias("vol"), text(6, 7).alias("work"), F.conv(F.hex(F.concat(F.substring(c, 14, 1), F.substring(c, 13, 1))), 16, 10).cast("int").alias("juan"),
        number(15, 4).alias("offset"), text(19, 4).alias("page"), text(23, 1).alias("col"), number(24, 1).cast("int").alias("line"),
    )
