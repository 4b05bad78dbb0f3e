"""Operator 11: importance resampling towards a target distribution of hashed word n-grams.

Words are lower-cased (A to Z) runs of ASCII letters and digits and of everything beyond ASCII; features are all runs of
1 to max_words of them, hashed by CRC-32 into buckets. Buckets of all texts and of the target's are counted, by arrays in
each task that Spark then adds up, and give each bucket a gain, the scaled logarithm of how much likelier the target is
to have it. A text's weight is the sum of its features' gains: one gather from the array of gains for a whole slice of
texts. Gumbel noise from the key's hash makes of the highest scores a draw without replacement.

How many rows are drawn follows from the number of eligible ones, so the last drawn one is found exactly by radix
selection: the composite key (score falling, key rising, row) is read as digits of 16 bits, and in each round the rows
that agree with the cut's first digits are counted by the next one. A round gives the driver 2**16 counts at most,
whatever the rows; digits that all rows share are passed over, and the rounds end as soon as a digit's rows are all
drawn. Only drawn rows are sorted, by ranges, and ranked by the sizes of the ranges before theirs.

Cases: null and empty texts have no words, weight 0, and are not eligible; a null key is hashed as the empty text and
comes behind all others of its score; repeated rows are counted each, and each may be drawn, in the order in which they
are numbered, which shows in no other column; without eligible rows nothing is drawn; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import fill, flat, lean, slices
from .workspace import Workspace

BUCKETS = 10_000
SCALE = 1000
DIGIT = 16
SHORT = 32  # words of up to so many bytes are hashed together, byte by byte; longer ones each by the library
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


_CRC = _crc_table()


def _extend(crc: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 sums, each carried on over the bytes raw[start : start + size]."""
    order = np.argsort(np.minimum(sizes, SHORT + 1).astype(np.uint8), kind="stable")[::-1]  # longest first: those with a j-th byte come first
    state, at, longest = ~crc[order], starts[order], sizes[order]
    long = int(np.searchsorted(-longest.clip(max=SHORT + 1), -SHORT, side="left"))
    n = len(order)
    for j in range(SHORT):
        n = int(np.searchsorted(-longest[:n].clip(max=SHORT + 1), -j, side="left"))
        if n <= long:
            break
        part = state[long:n]
        state[long:n] = _CRC[(part ^ raw[at[long:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~state
    for k in order[:long].tolist():
        out[k] = zlib.crc32(raw[starts[k] : starts[k] + sizes[k]], int(crc[k]))
    return out


def features(raw: np.ndarray, offsets: np.ndarray, max_words: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(first word of each text and the end; for each size of n-gram, (place of the first one of each text and the end, buckets' hashes))."""
    inside = _IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = inside & (np.r_[True, ~inside[:-1]] | edge[:-1]) if len(raw) else inside
    stop = inside & (np.r_[~inside[1:], True] | edge[1:]) if len(raw) else inside
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    firsts = np.searchsorted(starts, offsets)
    lower = _LOWER[raw]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found, kept = [], np.arange(len(starts))
    crc = _extend(np.zeros(len(starts), np.uint32), lower, starts, stops - starts)
    blank = np.zeros(1, np.int64)
    for n in range(1, max_words + 1):
        if n > 1:
            go = kept + n - 1 < len(starts)
            go[go] = owner[kept[go]] == owner[kept[go] + n - 1]
            kept, crc = kept[go], crc[go]
            spaced = _extend(crc, np.array([32], np.uint8), np.repeat(blank, len(kept)), np.ones(len(kept), np.int64))
            crc = _extend(spaced, lower, starts[kept + n - 1], (stops - starts)[kept + n - 1])
        found.append((np.searchsorted(kept, firsts), crc))
    return firsts, found


def _sliced(column: pa.Array, max_words: int) -> Iterator[tuple[int, int, np.ndarray, list]]:
    texts = fill(column)
    for start, stop in slices(texts):
        yield start, stop, *features(*flat(texts.slice(start, stop - start)), max_words)


def bucket_counts(docs: DataFrame, text: str, max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _sliced(batch.column(0), max_words):
                for _, crc in found:
                    sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(buckets, np.int64)
    sums[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln(p / q)) of each bucket, of shares with one added to each bucket."""
    s_all, t_all = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, keep: list[str], text: str, gain: np.ndarray, max_words: int = 1) -> DataFrame:
    """keep, n_words, n_features, weight: a row for each row of docs."""
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    names = [*plain.columns[:-1], "n_words", "n_features", "weight"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, firsts, found in _sliced(batch.column(len(keep)), max_words):
                n, weight = np.zeros(stop - start, np.int64), np.zeros(stop - start, np.int64)
                for places, crc in found:
                    sums = np.r_[0, np.cumsum(shared.value[crc % np.uint32(len(shared.value))])]
                    n += np.diff(places)
                    weight += np.diff(sums[places])
                mine = [batch.column(i).slice(start, stop - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(np.diff(firsts)), pa.array(n), pa.array(weight)], names)

    out = plain.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def noise(key: Column, seed: str) -> Column:
    """floor(-SCALE * ln(-ln(u))), u from the first 32 bits of the hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _digits(x: Column) -> list[Column]:
    """A 64-bit whole number, from its highest 16 bits on, so that they rise with it."""
    flipped = x.bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)) for shift in range(64 - DIGIT, -1, -DIGIT)]


def least(rows: DataFrame, order: list[Column], k: int) -> Column:
    """A test that holds for the first k rows by `order`, 64-bit whole numbers that are no row's twice; radix selection."""
    digits = [d for x in order for d in _digits(x)]
    spread = rows.agg(*[f(d).alias(f"{f.__name__}{i}") for i, d in enumerate(digits) for f in (F.min, F.max)]).first()
    if k <= 0 or spread["min0"] is None:
        return F.lit(False)
    chosen: list[tuple[Column, int]] = []
    left = rows
    for i, d in enumerate(digits):
        if spread[f"min{i}"] == spread[f"max{i}"]:
            continue
        counts = left.groupBy(d.alias("digit")).count().orderBy("digit").collect()  # 2 ** DIGIT rows at most
        for r in counts:
            if k <= r["count"]:
                break
            k -= r["count"]
        else:
            return F.lit(True)  # fewer rows than k
        chosen.append((d, r.digit))
        if k == r["count"]:
            break
        left = left.where(d == r.digit)
    if not chosen:
        return F.lit(True)
    return F.struct(*[d.alias(f"d{i}") for i, (d, _) in enumerate(chosen)]) <= F.struct(*[F.lit(v).cast("long").alias(f"d{i}") for i, (_, v) in enumerate(chosen)])


def ranked(rows: DataFrame, order: list[Column], name: str, work: Workspace) -> DataFrame:
    """rows with their place in the order from 1 on: sorted by ranges, each range's places behind those of the ones before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = work.save(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a row for each range
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in before]), part) if before else F.lit(0).cast("long")
    return placed.withColumn(name, offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def resample(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, *, percent: int = 10, least_words: int = 20, max_words: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """key, n_features, weight, score, rank (null if not drawn), n_words: a row for each row of docs.

    percent of the texts of at least least_words words are drawn.
    """
    work = Workspace(docs.sparkSession, "importance")
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    gain = gains(bucket_counts(plain, "text", max_words, buckets), bucket_counts(target, target_text, max_words, buckets))
    scored = weights(plain, ["key"], "text", gain, max_words)
    scored = scored.withColumns({"score": F.col("weight") + noise(F.col("key"), seed), "_row": F.monotonically_increasing_id()})
    scored = work.save(scored, "scored")  # rows keep their numbers by being written
    eligible = F.col("n_words") >= least_words
    order = [-F.col("score"), F.when(F.col("key").isNull(), 1).otherwise(0).cast("long"), F.coalesce("key", F.lit(0).cast("long")), F.col("_row")]
    first = least(scored.where(eligible), order, percent * scored.where(eligible).count() // 100)
    drawn = ranked(scored.where(eligible & first), order, "rank", work)
    rest = scored.where(~(eligible & first)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank", "n_words")
