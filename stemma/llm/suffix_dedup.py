"""Operator 4: exact substring dedup by suffix arrays.

Every string of LENGTH bytes that starts in two places is found, and all bytes that such strings cover are removed.

1. Each LENGTH-byte window is owned by the least of its GRAM-byte hashes, its anchor, which depends on its content
   alone: equal windows have equal anchors at equal distances. Windows next to each other share an anchor, so a text
   becomes a row of segments, each with its anchor's hash and its windows (1.2 anchors for 100 bytes).
2. Only anchors that occur twice go on: their hashes are counted with partial counts in each task, then joined back.
3. Equal segments become one, with their number, before any bytes are moved. Where an anchor has one segment alone, all
   its windows repeat and nothing is left to compare. The bytes of the other distinct segments are cut from one
   document that holds each.
4. Segments are dealt out by anchor hash, so all windows that may be equal meet. Each task packs them into shards of
   about SHARD bytes; a shard's suffix array is made by induced sorting, and the permuted common prefixes tell which
   windows have an equal: in the shard, or because their segment itself stands for several.
   Anchors whose segments exceed GROUP bytes are dealt again: the windows with about the same distance to the anchor share
   the bytes around it, and meet by a hash of those. The distances are cut finer (SPLITS) until a group fits;
   what never fits is counted by hashes of the whole windows, which needs no task to hold a group.
5. Repeated windows go back to every place of their segment, become byte runs of documents, and are cut out.

Hashes only choose what is compared: windows of different segments are equal by their bytes, but for those last ones.
Segments and such windows are merged on 128 bits of two hashes.

Cases: null and empty texts have no bytes; every row is a document, so that rows with one key and one text, or with a
null key, repeat each other like all others; rows of one key with different texts keep their own runs (rows.py); keys
are whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import fill, flat, lean, slices
from .induced_sort import permuted_common_prefixes, suffix_array
from .rows import COPIES, ID, numbered, with_ids
from .sieve import minimizers, texts_of
from .words import mix, powers
from .workspace import Workspace

LENGTH, GRAM = 200, 32
SHARD, GROUP = 2 << 20, 2 << 20
SPLITS = (2, 8)
PIECE = 4 << 20  # windows of a longer text are looked at in pieces
BROADCAST_RUNS = 64 << 20
HOT_KEYS = 1_000_000
_value = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_other = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    h, size = _value[raw], 1
    while size < GRAM:
        step = powers(GRAM + 1)[size]
        h = h[:-size] * step + h[size:]
        size *= 2
    return mix(h)


def segments_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor hash, segment hash, place of the anchor from the first window)."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = _grams(raw)
    anchor = minimizers(hashes, LENGTH - GRAM + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= offsets[1:][text]
    key = np.where(valid, anchor, -1)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    good = key[starts] >= 0
    starts, sizes = starts[good], sizes[good]
    stops = starts + sizes + LENGTH - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_other[raw] * powers(n), out=sums[1:])
    digest = mix((sums[stops] - sums[starts]) * powers(n, True)[starts])
    at = key[starts]
    return text[starts], starts - offsets[text[starts]], sizes, hashes[at].view(np.int64), digest.view(np.int64), at - starts


SEGMENTS = "key long, lo int, n int, anchor long, digest long, off int"


@lean
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            raw, offsets = flat(texts.slice(start, stop - start))
            keys = batch.column(0).slice(start, stop - start)
            # A text of more than PIECE bytes stands alone in its slice; its pieces overlap by all but one byte of a window.
            for a in range(0, max(1, len(raw) if stop - start == 1 else 1), PIECE):
                part, ends = (raw[a : a + PIECE + LENGTH - 1], None) if stop - start == 1 else (raw, offsets)
                text, lo, n, anchor, digest, off = segments_of(part, np.array([0, len(part)]) if ends is None else ends)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array((lo + a).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(digest), pa.array(off.astype(np.int32))], [x.split()[0] for x in SEGMENTS.split(", ")])


@lean
def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes of each distinct segment from the text that its row carries (last column)."""
    last, raw = None, b""
    for batch in batches:
        out = []
        for lo, n, text in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), fill(batch.column(6)).to_pylist()):
            if text is not last:
                last, raw = text, text.encode()
            out.append(raw[lo : lo + n + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(5), pa.array(out, pa.binary())], ["anchor", "digest", "n", "times", "off", "bytes"])


def repeated_windows(segments: list[bytes], windows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For the windows of all segments in order, whether each has an equal: elsewhere, or as its segment has several."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.int64) + 2
    t[starts + sizes] = 1
    t[-1] = 0
    sa = suffix_array(t, 258)
    before, length = permuted_common_prefixes(t, sa, starts)  # a segment is shorter than PREFIX_CAP
    inside = np.zeros(len(t), bool)
    at = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    inside[at] = True  # a window that ends inside its segment holds no separator
    hit = np.flatnonzero((length >= LENGTH) & inside)
    twice = np.zeros(len(t), bool)
    twice[hit] = True
    twice[before[hit]] = True
    return twice[at] | np.repeat(times > 1, windows)


MASKS = "anchor long, digest long, n int, mask binary"


@lean
def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in; a shard ends between groups."""
    names = ("group", "anchor", "digest", "n", "times", "off", "bytes", "part")
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        n = np.array([r[3] for r in rows])
        flags = repeated_windows([r[6] for r in rows], n, np.array([r[4] for r in rows]))
        out = []
        for row, a, b in zip(rows, np.cumsum(n) - n, np.cumsum(n)):
            if flags[a:b].any():
                full = np.zeros(row[8], bool)
                full[row[7] : row[7] + row[3]] = flags[a:b]
                out.append((row[1], row[2], row[8], np.packbits(full).tobytes()))
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["anchor", "digest", "n", "mask"])

    for batch in batches:
        for row in zip(*[batch.column(x).to_pylist() for x in (*names, "whole")]):
            if size >= SHARD and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush(held)


DEALT = "group long, anchor long, digest long, n int, times long, off int, bytes binary, part int, whole int"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 9
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in DEALT.split(", ")])


def _split(parts: int):
    """Deals the windows of each row by their distance to the anchor, cut into parts, and the bytes that those share."""
    reach = LENGTH - GRAM + 1
    bounds = [j * reach // parts for j in range(parts + 1)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, anchor, digest, n, times, off, raw, part, whole in zip(*[c.to_pylist() for c in batch.columns]):
                for near, far in zip(bounds, bounds[1:]):  # window w lies off - w bytes before the anchor: near to far - 1
                    a, b = max(0, off - far + 1), min(n, off - near + 1)
                    if a < b:
                        shared = hashlib.blake2b(raw[off - near : off + LENGTH - far + 1] + near.to_bytes(2, "little"), digest_size=8, key=group.to_bytes(8, "little", signed=True)).digest()
                        out.append((int.from_bytes(shared, "little", signed=True), anchor, digest, b - a, times, off - a, raw[a : b + LENGTH - 1], part + a, whole))
            yield _dealt(out)

    return run


@lean
def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each dealt row: two hashes of its bytes, and its place in its segment."""
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        raws = batch.column("bytes").to_pylist()
        raw = np.frombuffer(b"".join(raws), np.uint8)
        sizes = n + LENGTH - 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + inside
        hashes = []
        for values in (_value, _other):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values[raw] * powers(len(raw)), out=sums[1:])
            hashes.append(mix((sums[at + LENGTH] - sums[at]) * powers(len(raw), True)[at]).view(np.int64))
        row = np.repeat(np.arange(len(n)), n)
        place = batch.column("part").to_numpy().astype(np.int64)[row] + inside
        kept = [batch.column(c).take(pa.array(row)) for c in ("anchor", "digest", "whole", "times")]
        yield pa.RecordBatch.from_arrays([pa.array(hashes[0]), pa.array(hashes[1]), *kept, pa.array(place.astype(np.int32))], ["h", "g", "anchor", "digest", "n", "times", "place"])


@lean
def _place_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            flags = np.zeros(n, bool)
            flags[places] = True
            masks.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(masks, pa.binary())], ["anchor", "digest", "n", "mask"])


def _covered(key: np.ndarray, lo: np.ndarray, n: np.ndarray, masks: pa.Array) -> pa.RecordBatch:
    """For each key (rows sorted by key, lo) the maximal byte runs that its repeated windows cover."""
    masks = masks.combine_chunks() if isinstance(masks, pa.ChunkedArray) else masks
    ends = np.frombuffer(masks.buffers()[1], np.int32)[masks.offset : masks.offset + len(masks) + 1].astype(np.int64)
    flags = np.unpackbits(np.frombuffer(masks.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    at = np.flatnonzero(flags)
    row = np.searchsorted(8 * (ends[1:] - ends[0]), at, side="right")
    start = lo[row] + at - 8 * (ends[row] - ends[0])
    who = key[row]
    if ((start[1:] < start[:-1]) & (who[1:] == who[:-1])).any():  # a segment that was dealt in parts has several masks
        order = np.lexsort((start, who))
        start, who = start[order], who[order]
    fresh = np.r_[True, (who[1:] != who[:-1]) | (start[1:] - start[:-1] > LENGTH)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    owner = who[first]
    bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    offsets = pa.array(np.r_[bounds, len(owner)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start[first], start[last] + LENGTH)]
    return pa.RecordBatch.from_arrays([pa.array(owner[bounds]), *lists], ["key", "starts", "stops"])


@lean
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, lo) in; a key's rows are held until the next key comes."""
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        column = lambda i: t.column(i).to_numpy()
        return _covered(column(0), column(1).astype(np.int64), column(2), t.column(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # keys ascend
        if held and (cut or held[-1].column(0)[0].as_py() != keys[0]):
            yield done([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield done([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield done(held)


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast up to a counted number of rows."""
    return F.broadcast(df) if df.count() <= most else df


def _masks(distinct: DataFrame, plain: DataFrame, work: Workspace) -> list[DataFrame]:
    """MASKS of the distinct segments that hold a repeated window."""
    several = work.save(distinct.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("shared")), "several")
    rest = F.element_at(F.array(*map(F.lit, ("", "80", "C0", "E0", "F0", "F8", "FC", "FE"))), F.col("n") % 8 + 1)
    all_windows = F.unhex(F.concat(F.repeat(F.lit("FF"), F.floor(F.col("n") / 8).cast("int")), rest))
    is_shared = F.col("anchor") == F.col("shared")
    out = [distinct.join(several, is_shared, "left_anti").where("times > 1").select("anchor", "digest", "n", all_windows.alias("mask"))]
    distinct = distinct.join(several, is_shared, "left_semi")

    def cut(segments: DataFrame) -> DataFrame:
        needed = texts_of(plain, segments.select("key").distinct())
        with_text = segments.join(needed, "key").select("anchor", "digest", "n", "times", "lo", "off", "text")
        rows = with_text.mapInArrow(_cut_bytes, "anchor long, digest long, n int, times long, off int, bytes binary")
        return rows.select(F.col("anchor").alias("group"), "*", F.lit(0).alias("part"), F.col("n").alias("whole"))

    n = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = lambda df, by, size: df.groupBy(by).agg(F.sum(size).alias("size")).where(F.col("size") > GROUP).select(by)
    hot = work.save(sized(distinct, "anchor", F.col("n") + (LENGTH - 1)), "hot")
    fitting = []
    if hot.isEmpty():
        fitting.append(cut(distinct))
    else:
        hot = _few(hot, HOT_KEYS)
        fitting.append(cut(distinct.join(hot, "anchor", "left_anti")))
        large = cut(distinct.join(hot, "anchor", "left_semi"))
        for parts in SPLITS:
            dealt = work.save(large.mapInArrow(_split(parts), DEALT), f"dealt-{parts}")
            hot = work.save(sized(dealt, "group", F.octet_length("bytes")), f"hot-{parts}")
            large = None
            if hot.isEmpty():
                fitting.append(dealt)
                break
            hot = _few(hot, HOT_KEYS)
            fitting.append(dealt.join(hot, "group", "left_anti"))
            large = dealt.join(hot, "group", "left_semi")
        if large is not None:
            windows = work.save(large.mapInArrow(_window_hashes, "h long, g long, anchor long, digest long, n int, times long, place int"), "hot-windows")
            often = work.save(windows.groupBy("h", "g").agg(F.sum("times").alias("c")).where("c > 1").select("h", "g"), "hot-often")
            found = windows.join(often, ["h", "g"], "left_semi").groupBy("anchor", "digest", "n").agg(F.collect_list("place").alias("places"))
            out.append(found.mapInArrow(_place_masks, MASKS))
    columns = [x.split()[0] for x in DEALT.split(", ")]
    for part in fitting:
        out.append(part.select(columns).repartition(n, "group").sortWithinPartitions("group").mapInArrow(_shards, MASKS))
    return out


def repeated_runs(plain: DataFrame, work: Workspace) -> DataFrame:
    """key, starts, stops (arrays of byte places): the runs to remove. plain: id, text; ids don't repeat."""
    plain = plain.where(F.octet_length("text") >= LENGTH).withColumnRenamed("id", "key")
    found = work.save(plain.mapInArrow(_segments, SEGMENTS), "segments")
    often = work.save(found.groupBy("anchor").count().where("count > 1").select("anchor"), "often")  # a table, so that the join can be split where skewed
    places = work.save(found.join(often, "anchor", "left_semi"), "places")
    work.drop("segments", "often")
    distinct = places.groupBy("anchor", "digest", "n").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("key"), F.min_by("lo", "key").alias("lo"), F.min("off").alias("off"))
    distinct = work.save(distinct, "distinct")
    parts = _masks(distinct, plain, work)
    masks = parts[0]
    for part in parts[1:]:
        masks = masks.union(part)
    masks = work.save(masks, "masks")
    back = places.join(masks, ["anchor", "digest", "n"]).select("key", "lo", "n", "mask")
    n = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = work.save(back.repartition(n, "key").sortWithinPartitions("key", "lo").mapInArrow(_runs, "key long, starts array<int>, stops array<int>"), "runs")
    work.drop("places", "distinct", "masks", "hot", "several", "hot-windows", "hot-often", *[f"{x}-{k}" for k in SPLITS for x in ("dealt", "hot")])
    return runs


def dedup_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [fill(batch.column(1)).to_pylist(), *[batch.column(i).to_pylist() for i in (2, 3, 4)]]
            for t, starts, stops, copies in zip(*columns):
                raw, at, kept = t.encode(), 0, hashlib.sha256()
                if copies > 1 and len(raw) >= LENGTH:  # all of it stands in its copies
                    starts, stops = [0], [len(raw)]
                for a, b in zip(starts or (), stops or ()):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(stops or ()) - sum(starts or ()), len(starts or ()), kept.hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_runs(docs, key, text)
    return joined.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def _with_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    work = Workspace(docs.sparkSession, "suffix-dedup")
    plain, names = numbered(docs, key, text, work)
    runs = repeated_runs(plain, work)
    work.drop("rows")
    size = runs.agg(F.coalesce(F.sum(8 * F.size("starts") + 48), F.lit(0))).first()[0]
    rows = with_ids(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t", names)
    runs = F.broadcast(runs) if size <= BROADCAST_RUNS else runs
    return rows.join(runs, F.col(ID) == F.col("key"), "left").select(F.col("_k").cast("long").alias("key"), F.col("_t").alias("text"), "starts", "stops", F.col(COPIES).alias("copies"))
