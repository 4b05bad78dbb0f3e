"""Daily access counters as a stream: the upsert of a counter per request becomes an aggregation in update mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(visits: DataFrame, at: str, keys: list[Column | str], late: str = "1 day") -> DataFrame:
    """day, keys, visits; works on batches and streams. A stream forgets a day once it is `late` behind."""
    rows = visits.withWatermark(at, late) if visits.isStreaming else visits
    return rows.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("visits")).withColumn("day", F.to_date("w.start")).drop("w")


def write_counts(counts: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's changed counters as one Parquet batch; the newest batch of a counter holds its value."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{table_path}/epoch={epoch:010d}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "visits") -> DataFrame:
    """Counters of two tables added up (import of another server's counts)."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))
