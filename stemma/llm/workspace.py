"""Written intermediate tables in the folder that all executors share.

Operators cut lineage by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so that a lost
executor costs a re-read and not a re-computation. Tables are dropped as soon as they are not needed; what a
returned DataFrame still reads is removed when the session's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LIVE: list["Workspace"] = []
_OPENED: contextvars.ContextVar[list["Workspace"] | None] = contextvars.ContextVar("opened", default=None)  # inside closing(), in this thread


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; a local temporary one only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _LIVE.append(self)
        if (opened := _OPENED.get()) is not None:
            opened.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write df and return the table read back with df's own schema."""
        path = self.path(table)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def close(self) -> None:
        self._delete(self.root)
        if self in _LIVE:
            _LIVE.remove(self)

    def _delete(self, uri: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def closing() -> Iterator[None]:
    """Closes the workspaces that are opened inside, by this thread: for a result that is written before the block ends."""
    opened: list[Workspace] = []
    token = _OPENED.set(opened)
    try:
        yield
    finally:
        _OPENED.reset(token)
        for workspace in opened:
            workspace.close()


@atexit.register
def _close_all() -> None:
    for workspace in list(_LIVE):
        try:
            workspace.close()
        except Exception:  # the session has ended before: nothing to talk to
            pass
