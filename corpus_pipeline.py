"""A training-data pipeline over documents: rules, near duplicates, repeated passages, leaks, tokens.

Each stage works on all rows that the one before it left and returns the columns of documents; the last returns ids.
Rows are known by a number of their own (rows.py): doc_id where it is unique, else the number of its (doc_id, text), so
that a decision on one text never falls on another one with the same or with no doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.llm import decontaminate, minhash_forest, passages, quality_rules
from stemma.llm.piece_bpe import encode_decode
from stemma.llm.queries import tokenizer
from stemma.llm.rows import ID, names_of, with_ids
from stemma.llm.workspace import Workspace, closing

BROADCAST_KEYS = 1_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """docs with ID."""
    return with_ids(docs, "doc_id", "text", names_of(docs, "doc_id", "text", Workspace(docs.sparkSession, "pipeline-rows")))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows less those that gone (ID, distinct) names; gone is broadcast up to a checked number of rows."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, ID, "left_anti")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    judged = quality_rules.judge(rows, "text", "lang", "source", [ID, "lang", "source"])
    work = Workspace(spark, "pipeline-rules")
    gone = work.save(judged.where(~F.col("kept")).select(ID, "lang", "source").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    same = (rows[ID] == gone[ID]) & rows["lang"].eqNullSafe(gone["lang"]) & rows["source"].eqNullSafe(gone["source"])
    return rows.join(gone, same, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, also of rows with one doc_id and text."""
    rows = _rows(docs)
    found = minhash_forest.near_duplicates(rows, ID, "text")
    left = _without(rows, found.where(~F.col("kept")).select(ID).distinct())
    several = rows.groupBy(ID).count().where("count > 1").select(ID)
    if not several.isEmpty():  # rows of one id and one text
        again = left.join(several, ID, "left_semi").dropDuplicates([ID])
        left = left.join(several, ID, "left_anti").unionByName(again)
    return left.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    spans = passages.find_passages(rows, ID, "text")
    left = passages.remove_passages(rows, ID, "text", spans)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.find_leaks(rows, ID, "text", items, "item_id", "text")
    return _without(rows, leaks.select(ID).distinct()).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        coded = encode_decode(docs, "doc_id", "text", f.read())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("tokens", tokens),
]

ORACLE_SQL = None  # each stage's decisions are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with closing():  # a stage's own tables go as soon as its rows are written
            docs = work.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            work.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
