"""Operator 10: near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text's set of distinct SHINGLE-word shingles gives a digest, a signature of TREES * DEPTH minima, and a
   sketch of one bit of each. Texts with equal sets form a class; only its smallest key goes on.
2. Each tree sorts the classes by its own DEPTH signature values, cut to 16 bits. Rows that share the first SHALLOW
   values form a region. A region of more than REGION rows is split by one more value, as often as needed, so the
   depth adapts to each region. At full depth a region that is still larger links each row to its WINDOW
   predecessors and to the first row; the last step handles the rest. Sorting is by ranges over all trees at once: a
   hot region is spread over tasks, and a region that a range border cuts is cut in that tree alone.
3. First round: every row proposes, in each tree, its likest predecessor in the region by sketch. Each class keeps
   its two likest proposals. They are confirmed on full sets, and components are formed.
4. Second round: the forest is walked again with component labels. In a region of up to REGION rows by the first
   SHALLOW values every pair that the sketch doesn't rule out and whose components differ is confirmed. Within a
   large group of near copies nothing is left to do then, so no group gives all its pairs.
5. Rows of larger regions that hold several components, and of regions that a border cuts, in any tree, are joined
   once more, without the forest: each keeps the rarest shingles of its set, as many as a partner of the wanted
   similarity can't avoid all of (the prefix filter), and rows of different components that share one of them are
   confirmed. So texts on one template, whose regions are too large to be looked at row by row, lose no link.
   Shingles that one component alone holds are left out, so a group of near copies gives no pairs here either.

A pair of similarity 0.75 shares no region in any of 16 trees with probability 0.4375 ** 16 = 2e-6, and its sketch
falls under the limit with 1e-7. Measured recall of links against brute force stands in the README.

Cases: null and empty texts and texts without words have an empty set and are their own component; texts of fewer
words than a shingle are linked only if the whole sequence is equal; repeated rows are of one class; rows that share a
key are one node; a null key is never linked (component null); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow_text import fill, flat, lean, slices
from .components import components
from .sieve import texts_of
from .words import grams, mix, powers, word_hashes
from .workspace import Workspace

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
TREES, DEPTH, SHALLOW = 16, 8, 2
REGION, WINDOW = 48, 8
SKETCH_BITS = TREES * DEPTH
SKETCH_LIMIT = 91  # of 128: 5.5 standard deviations below what similarity 0.75 gives
BROADCAST_KEYS = 1_000_000
LEAD = 16
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 31, SKETCH_BITS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SKETCH_BITS, dtype=np.uint32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = flat(column)
    hashes, _, _, firsts = word_hashes(raw, offsets)
    five = grams(hashes, SHINGLE)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            whole = (hashes[a:b] * powers(SHINGLE)[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH_BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        block = x[None, i : i + 2048] * _A[:, None]
        block += _B[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            sets = shingle_sets(texts.slice(start, stop - start))
            digests, forests, sketches = [], [], []
            for s in sets:
                if not len(s):
                    digests.append(None), forests.append(None), sketches.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                spread = _signature(s) * np.uint32(0x9E3779B1)
                spread ^= spread >> np.uint32(15)
                spread *= np.uint32(0x85EBCA77)
                forests.append((spread >> np.uint32(16)).astype(">u2").tobytes())
                sketches.append(np.packbits((spread >> np.uint32(15)) & np.uint32(1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(forests, pa.binary()), pa.array(sketches, pa.binary())],
                ["key", "n_shingles", "digest", "forest", "sketch"],
            )


def _regions(tree: np.ndarray, order: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by tree and order (n x DEPTH): (first row of the row's region, whether the region is too large).

    Regions are split by up to deepest values.
    """
    n = len(tree)
    same = np.zeros((n, DEPTH + 1), bool)  # same[i, d]: row i agrees with row i - 1 in tree and the first d values
    same[1:, 0] = tree[1:] == tree[:-1]
    for d in range(DEPTH):
        same[1:, d + 1] = same[1:, d] & (order[1:, d] == order[:-1, d])
    starts = ~same[:, SHALLOW]
    for d in range(SHALLOW, deepest + 1):
        bounds = np.flatnonzero(starts)
        sizes = np.diff(np.r_[bounds, n])
        big = np.repeat(sizes > REGION, sizes)
        if d == deepest or not big.any():
            break
        starts |= big & ~same[:, d + 1]
    first = np.repeat(bounds, sizes)
    return first, big


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SKETCH_BITS - np.bitwise_count(a ^ b).sum(axis=1).astype(np.int16)


def _pairs(tree, order, key, sketch, component, best_only: bool, cut_before: bool, cut_behind: bool):
    """(smaller key, larger key, agreement, region, component) of the pairs that regions propose.

    The first or last region may be part of one that a border cuts. A row of a region that is left to the join by rare
    shingles is its own mate; in a region that is cut it comes with the region's number and its own component, as only
    all parts together say whether the region holds several components.
    """
    first, big = _regions(tree, order, DEPTH if best_only else SHALLOW)
    cut = np.zeros(len(tree), bool)
    if not best_only:  # a region of which a part lies elsewhere counts as large, however few rows are here
        cut = (cut_before & (first == first[0])) | (cut_behind & (first == first[-1]))
        big = big | cut
    depth_in = np.arange(len(tree)) - first
    window = WINDOW if best_only else 0  # the second round leaves large regions to the join by rare shingles
    steps = [(d, np.flatnonzero((depth_in >= d) & (~big | (d <= window)))) for d in range(1, max(REGION, WINDOW + 1))]
    leader = np.flatnonzero(big & (depth_in > WINDOW)) if best_only else np.zeros(0, np.int64)
    left = [rows - d for d, rows in steps if len(rows)] + [first[leader]]
    right = [rows for _, rows in steps if len(rows)] + [leader]
    best = np.zeros(len(tree), np.int16)
    mate = np.full(len(tree), -1)
    out = []
    for i, j in zip(left, right):
        differs = (component[i] != component[j]) & (key[i] != key[j])
        i, j = i[differs], j[differs]
        score = _agree(sketch[i], sketch[j])
        good = score >= SKETCH_LIMIT
        i, j, score = i[good], j[good], score[good]
        if best_only:
            better = score > best[j]
            best[j[better]], mate[j[better]] = score[better], i[better]
        else:
            out.append((i, j, score))
    if best_only:
        j = np.flatnonzero(mate >= 0)
        out = [(mate[j], j, best[j])]
    else:
        at = np.flatnonzero(big & (cut | _mixed(first, component)))
        out.append((at, at, np.full(len(at), -1, np.int16)))
    i, j, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    number = (tree.astype(np.int64) << 32) | (order[:, 0].astype(np.int64) << 16) | order[:, 1].astype(np.int64)  # SHALLOW values
    part = (i == j) & cut[i]
    return np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), score, np.where(part, number[i], -1), np.where(part, component[i], -1)


def _mixed(first: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Whether each row's region holds several components."""
    starts, place = np.unique(first, return_inverse=True)
    return (np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts))[place]


def _walk(best_only: bool):
    """Sorted rows in, proposals out; a region is held until it ends, at most held_most rows of it."""
    held_most = 16 * 1024

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut_before = None, True  # a partition's first region may begin in the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False)
            fixed = lambda k, t, w: np.frombuffer(b"".join(batch.column(k).to_pylist()), t).reshape(-1, w)
            now = [tree, fixed(1, ">u2", DEPTH), batch.column(2).to_numpy(zero_copy_only=False), fixed(3, "<u8", SKETCH_BITS // 64), batch.column(4).to_numpy(zero_copy_only=False)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1][:, :SHALLOW] != now[1][-1, :SHALLOW]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            full = len(now[0]) - cut > held_most
            cut = len(now[0]) if full else cut
            held = [x[cut:] for x in now]
            if cut:
                yield _batch(_pairs(*[x[:cut] for x in now], best_only, cut_before, full))
                cut_before = full
        if held is not None and len(held[0]):
            yield _batch(_pairs(*held, best_only, cut_before, True))

    return run


def _batch(pairs) -> pa.RecordBatch:
    a, b, score, region, component = pairs
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score.astype(np.int32)), pa.array(region, pa.int64()), pa.array(component, pa.int64())], ["a", "b", "agree", "region", "component"])


def _propose(nodes: DataFrame, best_only: bool) -> DataFrame:
    trees = nodes.select("key", "forest", "sketch", "component", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("tree", F.substring("forest", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("order"), "key", "sketch", "component")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "tree", "order").sortWithinPartitions("tree", "order", "key")
    return ranged.mapInArrow(_walk(best_only), "a long, b long, agree int, region long, component long")


@lean
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for column in (2, 3):
            texts = fill(batch.column(column))
            keep.append([s for start, stop in slices(texts) for s in shingle_sets(texts.slice(start, stop - start))])
        ok = []
        for x, y in zip(*keep):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike on their full shingle sets. docs: key, text of all nodes, unique."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    needed = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
    one = pairs.join(needed.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(needed.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


@lean
def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, component in; key, component, size of the set, shingle: a row for each shingle of each text."""
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            sets = shingle_sets(texts.slice(start, stop - start))
            sizes = np.array([len(s) for s in sets])
            row = pa.array(np.repeat(np.arange(len(sets)), sizes))
            keys, component = (batch.column(i).slice(start, stop - start).take(row) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([keys, component, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["key", "component", "size", "shingle"])


def _by_rare_shingles(nodes: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """Pairs a, b of nodes (key, component, sketch) that may be alike, by the rarest shingles of each set.

    Of two alike sets the larger one has a shingle of the smaller one's first 1 - 2s / (1 + s) among its own first 1 - s
    (s: the least similarity), and at the first such shingle both have enough shingles left. Texts that share less
    have none there but what is rare: their template stays out of the join.
    """
    named = texts_of(texts, nodes.select("key")).select("key", "text").join(nodes.select("key", "component"), "key")
    shingles = work.save(named.select("key", "text", "component").mapInArrow(_exploded, "key long, component long, size long, shingle long"), "shingles")
    # A text with so many shingles of its own that the rest can't make it alike to any other has no link here.
    own = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("key")).where("df = 1").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    sizes = shingles.groupBy("key").agg(F.first("size").alias("size"))
    open_ = work.save(sizes.join(own, "key", "left").where(_prefix(1) > F.coalesce("own", F.lit(0))).select("key"), "open")
    shingles = work.save(shingles.join(open_, "key", "left_semi"), "open-shingles")
    # What one component alone holds comes first in the order from rare to frequent, and meets nothing.
    ends = [F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high")]
    shared = work.save(shingles.groupBy("shingle").agg(*ends).where("low < high").select("shingle", "df"), "shared")
    held = shingles.join(shared, "shingle").groupBy("key").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    alone = F.col("size") - F.size("held")
    rows = held.select("key", "size", alone.alias("alone"), F.posexplode(F.slice("held", 1, F.greatest(_prefix(1) - alone, F.lit(0)).cast("int"))).alias("i", "x"))
    half = lambda i: F.conv(F.hex(F.substring("sketch", i, 8)), 16, -10).cast("long")
    known = nodes.select("key", "component", half(1).alias("s"), half(9).alias("t"))
    rows = rows.select("key", "size", (F.col("i") + F.col("alone")).alias("at"), F.col("x.shingle").alias("shingle")).join(known, "key")
    rows = work.save(rows, "prefixes")
    mixed = work.save(rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle"), "mixed")
    rows = work.save(rows.join(mixed, "shingle", "left_semi"), "mixed-prefixes")
    # Two texts meet at each of their common shingles, in the same order; they are paired at the first one that both have
    # among their LEAD rarest, and only where there is none at each.
    ahead = F.slice(F.sort_array(F.collect_list(F.struct("at", "shingle"))), 1, LEAD)
    rows = rows.join(rows.groupBy("key").agg(ahead.alias("ahead")), "key")
    lead = lambda most: F.transform(F.filter("ahead", lambda x: x["at"] < most) if most is not None else F.col("ahead"), lambda x: x["shingle"])
    small = rows.where(F.col("at") < _prefix(2)).withColumn("lead", lead(_prefix(2))).select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("key", "size", "at", "component", "s", "t", "lead")])
    rows = rows.withColumn("lead", lead(None)).drop("ahead")
    agree = SKETCH_BITS - F.bit_count(F.col("s").bitwiseXOR(F.col("s_b"))) - F.bit_count(F.col("t").bitwiseXOR(F.col("t_b")))
    alike = (F.struct("size_b", "key_b") < F.struct("size", "key")) & (F.col("component") != F.col("component_b")) & (DENOMINATOR * F.col("size_b") >= NUMERATOR * F.col("size"))
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    alike = alike & ((NUMERATOR + DENOMINATOR) * left >= NUMERATOR * (F.col("size") + F.col("size_b"))) & (agree >= SKETCH_LIMIT)
    alike = alike & F.coalesce(F.get(F.array_intersect("lead", "lead_b"), F.lit(0)) == F.col("shingle"), F.lit(True))
    return rows.join(small, "shingle").where(alike).select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def _prefix(sides: int) -> Column:
    """How many shingles of a set of `size` hold one of those that a partner shares: one that is at least as large (2), or any (1)."""
    enough = F.ceil(sides * NUMERATOR * F.col("size") / (NUMERATOR + DENOMINATOR if sides == 2 else DENOMINATOR))
    return F.col("size") - enough + 1


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    work = Workspace(spark, "minhash-forest")
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = work.save(plain.mapInArrow(_sign, "key long, n_shingles long, digest binary, forest binary, sketch binary"), "signed")
    classes = work.save(signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("key").alias("rep")), "classes")
    firsts = signed.join(classes, "digest").where(F.col("key") == F.col("rep")).dropDuplicates(["key", "digest"])
    nodes = work.save(firsts.select("key", "forest", "sketch", F.col("key").alias("component")), "nodes")
    texts = plain.where(F.col("key").isNotNull())
    likest = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
    first = _propose(nodes, True).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    first = first.withColumn("place", F.row_number().over(likest)).where("place <= 2").select("a", "b")
    links = work.save(_confirmed(work.save(first, "pairs-1"), texts), "links-1")
    labels = work.save(components(links, work, "round-1"), "labels-1")
    named = lambda rows: rows.drop("component").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    proposed = work.save(_propose(named(nodes), False).drop("agree").distinct(), "proposed")
    own = proposed.where("a = b")
    mixed = own.where("region >= 0").groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
    crowded = own.where("region < 0").select("a").union(own.join(mixed, "region", "left_semi").select("a")).distinct()
    crowded = nodes.join(crowded.select(F.col("a").alias("key")), "key", "left_semi")

    more = [work.save(proposed.where("a <> b").select("a", "b"), "pairs-2")]
    crowded = work.save(named(crowded), "crowded")
    if not crowded.isEmpty():
        more.append(work.save(_by_rare_shingles(crowded, texts, work), "pairs-3"))
    found = [work.save(_confirmed(pairs, texts), f"links-{i}") for i, pairs in enumerate(more, start=2) if not pairs.isEmpty()]
    if found:
        for part in found:
            links = links.union(part)
        labels = work.save(components(links, work, "round-2"), "labels-2")
    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("key", "n_shingles", "digest").join(found, "digest", "left").withColumn("component", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")))
    out = out.select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))
    out = work.save(out, "out")
    work.drop("signed", "classes", "nodes", "proposed", "crowded", "shingles", "open", "open-shingles", "shared", "prefixes", "mixed", "mixed-prefixes", *[f"{x}-{k}" for k in (1, 2, 3) for x in ("pairs", "links", "labels")])
    return out
