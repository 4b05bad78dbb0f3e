"""Documents by a whole number of their own, whatever their keys are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace


def version_of(text: Column) -> Column:
    """Tells texts of one key apart."""
    return F.xxhash64(text)


ID, COPIES = "_row_id", "_row_copies"


def names_of(docs: DataFrame, key: str, text: str, work: Workspace) -> DataFrame | None:
    """id, key, version, copies of the distinct (key, text), as a written table; None where keys are unique and not null.

    Ids rise with (key, version), null keys first.
    """
    keys = docs.select(F.col(key).cast("long").alias("key"))
    if keys.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        return None
    rows = docs.select(F.col(key).cast("long").alias("key"), version_of(F.col(text)).alias("version"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.groupBy("key", "version").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(n, "key", "version").sortWithinPartitions("key", "version")
    return work.save(ordered.withColumn("id", F.monotonically_increasing_id()), "names")  # ids are fixed by being written


def with_ids(docs: DataFrame, key: str, text: str, names: DataFrame | None) -> DataFrame:
    """docs with ID and COPIES of each row: the key itself, or what names_of() says."""
    if names is None:
        return docs.withColumns({ID: F.col(key).cast("long"), COPIES: F.lit(1).cast("long")})
    known = names.select(F.col("key").alias("_row_key"), F.col("version").alias("_row_version"), F.col("id").alias(ID), F.col("copies").alias(COPIES))
    same = F.col(key).cast("long").eqNullSafe(F.col("_row_key")) & (version_of(F.col(text)) == F.col("_row_version"))
    return docs.join(known, same).drop("_row_key", "_row_version")


def numbered(docs: DataFrame, key: str, text: str, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """(id, text of the distinct documents; names_of() them). Where keys are no ids, the former is a written table."""
    names = names_of(docs, key, text, work)
    plain = with_ids(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", names).select(F.col(ID).alias("id"), "text")
    return (plain, None) if names is None else (work.save(plain.dropDuplicates(["id"]), "rows"), names)
