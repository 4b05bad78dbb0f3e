"""Operator 6: token ids in binary files of Simple-8b blocks.

Documents are dealt out by ranges of their key and sorted in each range; each range is encoded and written as one
file, streaming, by the executor that holds it. A file's name holds its attempt, and only the manifest, which Spark
commits, says which files count: repeated or lost tasks never touch each other's files, and what they leave is removed
behind the manifest. The order of files is the order of ranges; a manifest row for each file holds its counts, from
which each file's first id follows.

File (little endian): MAGIC; then blocks one after the other, each its words and then its escapes; then the index:
int64 keys[n_docs], int64 lengths[n_docs], int64 word_counts[n_blocks], int64 escape_counts[n_blocks]; then the
tail: int64 n_docs, int64 n_ids, int64 n_blocks, MAGIC. Block b holds ids [b * BLOCK, (b + 1) * BLOCK) of the file.

Cases: null and empty texts have the end id alone; repeated keys keep all their rows, ties in no stated order among
themselves; a null key sorts first and is written as the smallest 64-bit integer; an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from . import simple8b
from .arrow_text import fill, slices
from .library_tokens import made, read
from .workspace import Workspace

MAGIC = b"S8BTOK01"
NULL_KEY = -(1 << 63)
SLICE = 4 << 20  # bytes of text encoded at a time
STRIDE = simple8b.BLOCK * 1024  # ids coded at a time
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class FileWriter:
    """Appends documents; holds at most STRIDE ids and the index in memory."""

    def __init__(self, stream):
        self.stream, self.rest = stream, np.zeros(0, np.uint64)
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        stream.write(MAGIC)

    def append(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.lengths.append(lengths.astype("<i8"))
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // simple8b.BLOCK * simple8b.BLOCK
        for i in range(0, whole, STRIDE):
            self._write(ids[i : min(i + STRIDE, whole)])
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        coded = simple8b.encode(ids)
        n_words, n_escapes = np.diff(coded.word_ends), np.diff(coded.escape_ends)
        if len(coded.escapes):
            at = np.repeat(coded.word_ends[1:], n_escapes)
            self.stream.write(np.insert(coded.words, at, coded.escapes).astype("<u8").tobytes())
        else:
            self.stream.write(coded.words.astype("<u8").tobytes())
        self.words.append(n_words)
        self.escapes.append(n_escapes)

    def finish(self) -> tuple[int, int]:
        if len(self.rest):
            self._write(self.rest)
        join = lambda parts: np.concatenate([np.zeros(0, "<i8"), *parts]).astype("<i8")
        keys, lengths, words, escapes = (join(x) for x in (self.keys, self.lengths, self.words, self.escapes))
        for part in (keys, lengths, words, escapes, np.array([len(keys), lengths.sum(), len(words)], "<i8")):
            self.stream.write(part.tobytes())
        self.stream.write(MAGIC)
        return len(keys), int(lengths.sum())


class FileReader:
    """Random access to a file: the index is read once, ids by ranges of blocks."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        tail = self._read(size - 32, 32)
        if tail[24:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_blocks = np.frombuffer(tail, "<i8", 3).tolist()
        index = np.frombuffer(self._read(size - 32 - 16 * (n_docs + n_blocks), 16 * (n_docs + n_blocks)), "<i8")
        self.keys, self.lengths = index[:n_docs], index[n_docs : 2 * n_docs]
        self.n_words, self.n_escapes = index[2 * n_docs : 2 * n_docs + n_blocks], index[2 * n_docs + n_blocks :]
        self.at = 8 + 8 * np.r_[0, np.cumsum(self.n_words + self.n_escapes)]

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // simple8b.BLOCK, -(-stop // simple8b.BLOCK)
        raw = np.frombuffer(self._read(int(self.at[first]), int(self.at[last] - self.at[first])), "<u8")
        n_words, n_escapes = self.n_words[first:last], self.n_escapes[first:last]
        both = np.cumsum(n_words + n_escapes)
        is_escape = np.zeros(len(raw), bool)
        if n_escapes.any():
            at = np.repeat(both - n_escapes, n_escapes) + np.arange(n_escapes.sum()) - np.repeat(np.cumsum(n_escapes) - n_escapes, n_escapes)
            is_escape[at] = True
        counts = np.minimum(simple8b.BLOCK, self.n_ids - np.arange(first, last) * simple8b.BLOCK)
        values = simple8b.decode(raw[~is_escape], raw[is_escape], np.r_[0, np.cumsum(n_words)], counts)
        return values[start - first * simple8b.BLOCK : stop - first * simple8b.BLOCK]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, lengths, ids) of runs of documents, each of about STRIDE ids or one document."""
        ends = np.cumsum(self.lengths)
        i = 0
        while i < len(self.keys):
            base = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + STRIDE, side="right")))
            yield self.keys[i:j], self.lengths[i:j], self.ids(base, int(ends[j - 1]))
            i = j


def write_token_files(docs: DataFrame, key: str, text: str, tokenizer_path: str, folder: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Writes the files and their manifest below folder; returns the manifest (one row for each file)."""
    spark = docs.sparkSession
    kind, blob = read(tokenizer_path)
    shared = spark.sparkContext.broadcast(blob)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        coder, writer, shard, name = made(kind, shared.value), None, 0, ""
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = batch.column(2)[0].as_py()
                name = f"part-{shard:06d}-{uuid.uuid4().hex}.s8b"
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name}")
                writer = FileWriter(stream)
            texts = fill(batch.column(1))
            for start, stop in slices(texts, SLICE):
                ids, ends = coder.ids(texts.slice(start, stop - start))
                keys = batch.column(0).slice(start, stop - start).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
                writer.append(keys, np.insert(ids, ends[1:], end_id), np.diff(ends) + 1)
        if writer is not None:
            n_docs, n_ids = writer.finish()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_ids])], ["shard", "path", "n_docs", "n_ids"])

    ranged = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key")
    manifest = ranged.withColumn("shard", F.spark_partition_id()).mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    _sweep(folder, {r.path for r in manifest.select("path").collect()})
    return manifest


def _sweep(folder: str, kept: set[str]) -> None:
    """Removes the files of attempts that the manifest doesn't list."""
    fs, root = place(folder)
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.endswith(".s8b") and f"{folder}/{info.base_name}" not in kept:
            fs.delete_file(info.path)


def read_token_files(manifest: DataFrame, schema: str, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """each(keys, starts, lengths, ids) for runs of documents of every file; starts count from the first file's first id.

    The manifest has one row for each file, a number that the caller sets, so it passes through the driver.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.collect())
    before = [0, *accumulate(f.n_ids for f in files)]
    rows = [(f.path, b) for f, b in zip(files, before)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = place(path)
                with fs.open_input_file(name) as source:
                    for keys, lengths, ids in FileReader(source).documents():
                        ends = start + np.cumsum(lengths)
                        yield each(keys, ends - lengths, lengths, ids)
                        start = int(ends[-1])

    listed = spark.createDataFrame(rows, "path string, start long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder, reads them back: key, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    work = Workspace(spark, "token-files")
    manifest = write_token_files(docs, key, text, tokenizer_path, work.path("files"), end_id)

    def digest(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(lengths)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist())]
        null = keys == NULL_KEY
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    out = work.save(read_token_files(manifest, "key long, start long, n_tokens long, ids_crc32 long", digest), "digests")
    work.drop("files")
    return out.withColumnRenamed("key", key)
