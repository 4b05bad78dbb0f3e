"""Operator 9: token counts through a digest cache.

A text's key is the SHA-256 digest of its normalised content (null becomes the empty text; nothing else may change,
as it would change counts) and of the tokenizer file. Stored counts are joined by digest; only distinct texts
without a stored count are encoded; their counts are appended to the cache, a Parquet table partitioned by
tokenizer. The misses are found by digests alone, so only texts that are to be encoded are moved. Rows of one text are
reduced to one in each task before the shuffle, so that many copies meet as one row for each task, and the last join
moves digests and numbers, which adaptive execution splits when one is frequent.

Cases: null and empty texts have 0 tokens; repeated rows give repeated rows; an empty table gives no rows; a cache
row written twice by a repeated run holds the same count and is read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import fill, slices
from .library_tokens import made, read
from .workspace import Workspace

BROADCAST_DIGESTS = 1_000_000
CACHE = "digest binary, n_tokens long, tokenizer string"


def _append(missing: DataFrame, kind: str, blob: bytes, tokenizer: str, cache: str) -> None:
    shared = missing.sparkSession.sparkContext.broadcast(blob)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = made(kind, shared.value)
        for batch in batches:
            texts = fill(batch.column(1))
            for start, stop in slices(texts):
                _, ends = coder.ids(texts.slice(start, stop - start))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(np.diff(ends))], ["digest", "n_tokens"])

    out = missing.select("digest", "content").mapInArrow(count, "digest binary, n_tokens long")
    out.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").option("compression", "zstd").parquet(cache)


def _stored(spark, cache: str, tokenizer: str) -> DataFrame:
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def count_tokens(docs: DataFrame, key: str, text: str, tokenizer_path: str, cache: str) -> DataFrame:
    """One row for each document: key, n_bytes, n_tokens. cache: folder of the digest cache, made if absent."""
    spark = docs.sparkSession
    kind, blob = read(tokenizer_path)
    tokenizer = hashlib.sha256(kind.encode() + blob).hexdigest()[:32]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), content.alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("content"), 256)))
    missing = rows.select("digest", "content")
    work = Workspace(spark, "token-counts")
    if _exists(spark, cache):
        lacking = work.save(rows.select("digest").distinct().join(_stored(spark, cache, tokenizer), "digest", "left_anti"), "lacking")
        missing = missing.join(F.broadcast(lacking) if lacking.count() <= BROADCAST_DIGESTS else lacking, "digest", "left_semi")
    _append(missing.dropDuplicates(["digest"]), kind, blob, tokenizer, cache)
    work.drop("lacking")
    # The counts of these documents as a table: a join to an aggregate can't be split where a digest is frequent.
    needed = rows.select("digest").distinct().join(_stored(spark, cache, tokenizer), "digest")
    needed = work.save(needed, "needed")
    sized = rows.select("key", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sized.join(needed, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
