"""Written tables in the folder that all executors share: cutting lineage between the steps of a loop, stored indexes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder, which is deleted when the process ends: what is returned from it may be read until then."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back, so that a lost executor costs a re-read and a loop's plan stays short."""
    path = new_folder(df.sparkSession, "cut")
    kept = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    kept.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for spark, uri in _MADE:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before: nothing to talk to
            pass
