"""Writers."""

from __future__ import annotations

import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def as_json(df: DataFrame, callback: str | None = None) -> DataFrame:
    """One JSON text for each row; with a callback as its argument."""
    body = F.to_json(F.struct(*df.columns))
    return df.select((F.concat(F.lit(f"{callback}("), body, F.lit(")")) if callback else body).alias("json"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def metadata(works: DataFrame, canons: DataFrame) -> DataFrame:
    """Bibliographic rows of works with a text of their own, with the constants of the exchange format."""
    joined = works.where("alt is null").join(canons.select(F.col("id2").alias("canon"), F.col("name").alias("canon_name")), "canon", "left")
    checked = joined.where(F.assert_true(F.col("canon_name").isNotNull(), "unknown canon").isNull())
    return checked.select(F.col("n").alias("primary_id"), "title", "byline", "canon_name", *[F.lit(v).alias(k) for k, v in (("fulltext_search", "y"), ("fulltext_read", "y"), ("fulltext_download", "y"), ("image", "n"))]).orderBy("primary_id")


def replace(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replaces the whole table, or with `by` only the partitions that df has rows of."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def insert_new(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows and those of new keys; of several rows of a new key the first in order."""
    new = rows.join(existing.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return existing.unionByName(new, allowMissingColumns=True)


def text_per_key(df: DataFrame, keys: Sequence[str], text: str, path: str) -> None:
    """A folder for each key with its text."""
    df.select(*keys, F.col(text).alias("value")).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def zip_per_key(df: DataFrame, key: str, name: str, text: str, path: str) -> DataFrame:
    """An archive of each key's texts, written where its rows meet; key, path, files of each. A task holds one text at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for k, mine in itertools.groupby(rows, key=lambda r: r[0]):
            n = 0
            with fs.open_output_stream(f"{root}/{k}.zip") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
                for _, file, content in mine:
                    archive.writestr(zipfile.ZipInfo(file), content or "", zipfile.ZIP_DEFLATED)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"{path}/{k}.zip"]), pa.array([n], pa.int32())], ["key", "path", "files"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.repartition("key").sortWithinPartitions("key", "name").mapInArrow(write, "key string, path string, files int")


def statistics(works: DataFrame, measures: Sequence[str], by: Sequence[str], path: str) -> None:
    """A CSV of the measures for each of the columns by (work, volume, category), and a JSON line of the totals."""
    sums = [F.sum(m).alias(m) for m in measures]
    for column in by:
        csv(works.groupBy(column).agg(*sums).orderBy(column).coalesce(1), f"{path}/{column}")
    json_lines(works.agg(*sums), f"{path}/total")


def sorted_csv_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> None:
    df.repartition(*keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).csv(path, header=True)


def xml_docset(df: DataFrame, path: str, row: str = "document") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", "docset").option("rowTag", row).save(path)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a staged folder in the place of the published one, which is kept beside it until the swap is done."""
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    kept = jvm.org.apache.hadoop.fs.Path(path + ".before")
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)
    if not fs.rename(new, old):
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(kept, True)


def _file_system(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _file_system(spark, uri)
    return fs.exists(path)


def delete(spark: SparkSession, uri: str) -> None:
    fs, path = _file_system(spark, uri)
    fs.delete(path, True)


def escaped(spark: SparkSession, value: str) -> str:
    """A value as Spark writes it in the name of a partition's folder."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def listing(changes: DataFrame, version: str, order: Sequence[str], text: str) -> DataFrame:
    """One text for each version: a heading and its lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return changes.groupBy(version).agg(F.concat(F.lit("# "), F.first(version), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def tree_json(rows: DataFrame, levels: Sequence[str], leaf: Sequence[str]) -> DataFrame:
    """Nested JSON by levels, one row for each top value."""
    from ..operators.stats import nested

    out = nested(rows, levels, F.struct(*leaf))
    return out.select(levels[0], F.to_json(F.struct(levels[0], "items")).alias("json"))
