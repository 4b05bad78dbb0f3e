"""Operator 8: substring dedup of fuzzy passages by collinear chaining.

1. Equal texts are one document; every further copy is a passage of the first one as a whole.
2. Seeds: SEED-word hashes, thinned to the least of every SPREAD neighbours, so that any equal run of
   SEED + SPREAD - 1 words shares one, and of 51 words two. Anchors: each window of MIN_WORDS words is owned by the least
   of its ANCHOR-word hashes; the windows next to each other that one anchor owns are a segment. Equal windows have
   equal anchors at equal distances.
3. Each seed or anchor that occurs in several documents has a source: its place in the document of the smallest key.
   Every other occurrence is matched to that place, and a document's first occurrence of a seed also to the one in the
   document before its own, by keys. So a seed of a third of all documents gives two rows for each of them and no
   pairs, and a passage is met whether its source is the first text that holds its bits or the last one before. Counts
   are aggregated in each task before the shuffle; the join that follows is split by adaptive execution where a seed
   is frequent, and the holders of a seed are dealt by hashes of their keys to crowds of about CROWD, in which the one
   before is looked for.
4. Equal segments are reduced to one, with its first place. Where an anchor has different segments, the windows of each
   distinct one are hashed and matched to the first document that holds them. So every word of an equal run of
   MIN_WORDS words is found, whichever documents hold its seeds, at a cost that follows the distinct segments. These
   runs join the matches, and stay as rows where no alignment holds them.
5. Of a document's sources those with the most matches come first; one whose places they span already is left to step 7 (its
   equal runs still stay). The matches of a document with one source document are chained: the best score over matches that lie before in
   both texts comes from a Fenwick tree over source places, where the linear gap costs are part of the key.
   A single match is enough if at most RARE documents hold its seed: those are all met in step 3.
6. The words of both sides are fetched for each chain, equal stretches between matches are taken as they are, gaps
   are aligned by longest common subsequence, and both ends are extended. A passage needs MIN_WORDS equal words and
   IDENTITY of the longer side; a chain that lacks it is cut at its worst gap, and each side is judged by itself.
7. So steps 3 and 5 try a few sources for each place. A seed that no passage covers then is open if more than RARE
   documents hold it, and all earlier documents are tried for it. A passage that is no equal run of MIN_WORDS words has a
   gap between two runs. Either two seeds stand on its sides, at most NEAR words apart, both sides together: documents
   meet by links, two seeds in one order, where the words between differ; a link with the same words everywhere is part
   of one run and meets nothing. Or the run around an open seed goes on behind a skip: contexts of a seed (AROUND words
   on both sides) are sorted, and where they branch they meet by the 4 words that follow the skip. So documents that
   share a line and nothing more make no pairs. Equal contexts are one, with the earliest document as its source, and a
   pair of contexts that ends with fewer than MIN_WORDS equal words is left. Places in stretches that repeat a few words
   are their two ends. Each pair found is chained with all its matches near open places and aligned. Contexts of a
   seed are dealt out in blocks of BLOCK.

The document of the smaller key always keeps its words, so that removal leaves a copy of everything.

Cases: null, empty and short texts have no passages; repeats inside one document are left; rows that share a key and a
text are one document; rows of one key with different texts, or with a null key, are documents of their own, told
apart by version (rows.py), a hash of the text that is null where keys are unique; keys are whole numbers; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrow_text import fill, flat, lean, slices
from .rows import numbered, version_of
from .sieve import minimizers, texts_of
from .words import grams, mix, powers, word_hashes
from .workspace import Workspace

SEED, SPREAD = 5, 20
MIN_WORDS, IDENTITY = 30, 0.8
ANCHOR = 15
GAIN, GAP_COST, MIN_SEEDS = 10.0, 0.15, 2
RARE = 3  # documents that hold a seed which may stand alone for a passage
CROWD = 2_000  # holders of a seed among which a row looks for the one before it
NEAR = int(GAIN / GAP_COST)  # words between the first two matches of a chain, both sides together, at most
AROUND = MIN_WORDS - SEED + 7  # words beside a lone seed: a run shorter than MIN_WORDS, 3 skipped words, 4 equal ones
BLOCK = 20_000  # contexts of a seed on each side of a block
PAD, STEP = 64, 20
SPAN_GAP, BIN, NEW_BINS = 48, 8, 2  # words without a match inside a span, words in a bin, bins that a source must add
BROADCAST_SPANS, BROADCAST_COPIES, BROADCAST_SEEDS = 300_000, 1_000_000, 1_000_000
SPANS = "key long, start int, stop int, source long, source_start int, source_stop int, n_equal int, identity double"


SEEDS = "key long, seed long, pos int, first boolean, digest long, n int, off int"  # n: windows of an anchor's segment, 0 for a seed


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    return np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])][: len(columns[0])]


def _first_of(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is the first of its kind in its document; doc ascends."""
    order = np.argsort(hashes, kind="stable")
    out = np.zeros(len(doc), bool)
    out[order] = _new(hashes[order], doc[order])
    return out


def _listed(column: pa.Array, start: int, stop: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(row of each entry, fields) of the lists of structs in rows start to stop."""
    offsets = column.offsets.to_numpy()[start : stop + 1]
    fields = [x.slice(offsets[0], offsets[-1] - offsets[0]) for x in column.values.flatten()]
    return np.repeat(np.arange(stop - start), np.diff(offsets)), fields


@lean
def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SEEDS.split(", ")]
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            raw, offsets = flat(texts.slice(start, stop - start))
            hashes, _, _, firsts = word_hashes(raw, offsets)
            keys = batch.column(0).slice(start, stop - start)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
            ends = firsts[1:][text]

            def rows(at, fp, digest, n, off):
                doc = text[at]
                is_first = pa.array(_first_of(doc, fp))
                ints = [pa.array(x.astype(np.int32)) for x in (at - firsts[doc], n, off)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(fp), ints[0], is_first, pa.array(digest), ints[1], ints[2]], names)

            seeds = grams(hashes, SEED)
            place = minimizers(seeds, SPREAD)
            at = np.unique(place[np.arange(len(place)) + SEED + SPREAD - 1 <= ends[: len(place)]])
            none = np.zeros(len(at), np.int64)
            yield rows(at, seeds[at].view(np.int64), none, none, none)
            wide = grams(hashes, ANCHOR)
            place = minimizers(wide, MIN_WORDS - ANCHOR + 1)
            if not len(place):
                continue
            owner = np.where(np.arange(len(place)) + MIN_WORDS <= ends[: len(place)], place, -1)
            lo = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1 : len(owner)] != text[: len(owner) - 1])])
            n = np.diff(np.r_[lo, len(owner)])
            good = owner[lo] >= 0
            lo, n = lo[good], n[good]
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
            digest = mix((sums[lo + n + MIN_WORDS - 1] - sums[lo]) * powers(len(hashes), True)[lo]).view(np.int64)
            yield rows(owner[lo], wide[owner[lo]].view(np.int64), digest, n, owner[lo] - lo)


WINDOWS = "window long, key long, pos int, seed long, digest long, n int, i int, times long"


@lean
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, segments (seed, digest, n, lo, times) in; a row for each window of each segment out."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            hashes, _, _, firsts = word_hashes(*flat(texts.slice(start, stop - start)))
            hashes = grams(hashes, MIN_WORDS).view(np.int64)
            text, (seed, digest, n, lo, times) = _listed(batch.column(2), start, stop)
            size = n.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = lo.to_numpy()[row] + i
            seed, digest, n, times = (x.take(pa.array(row)) for x in (seed, digest, n, times))
            key = batch.column(0).slice(start, stop - start).take(pa.array(text[row]))
            columns = [pa.array(hashes[firsts[text[row]] + at]), key, pa.array(at.astype(np.int32)), seed, digest, n, pa.array(i.astype(np.int32)), times]
            yield pa.RecordBatch.from_arrays(columns, names)


INTERVALS = "seed long, digest long, n int, i int, size int, source long, r int"


@lean
def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment and the (i, source, r) of its windows in; stretches of windows that lie on one diagonal of one source out."""
    for batch in batches:
        row, fields = _listed(batch.column(3), 0, batch.num_rows)
        i, source, r = (x.to_numpy() for x in fields)
        order = np.lexsort((i, row))
        row, i, source, r = (x[order] for x in (row, i, source, r))
        first = np.flatnonzero(_new(row, source, i - np.arange(len(i)), r - i))
        kept = [c.take(pa.array(row[first])) for c in batch.columns[:3]]
        columns = [*kept, *[pa.array(x) for x in (i[first], np.diff(np.r_[first, len(i)]).astype(np.int32), source[first], r[first])]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INTERVALS.split(", ")])


CHAINS = "key long, source long, d array<int>, r array<int>"
EXACT = SPANS + ", run int, run_start int, run_source int"  # with the longest run on one diagonal: words, first word of each side


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, source, diagonal, start, size in windows), sorted by all but size, in; EXACT of the stretches that they make up out.

    In a text that repeats itself many windows have the same source place, each on a diagonal of its own: such runs are
    one stretch, whose source side is the stretch that holds all their places.
    """
    held = None

    def done(key, source, diagonal, start, size) -> pa.RecordBatch:
        # Pieces of one diagonal follow each other; two windows that touch or overlap share a run.
        fresh = np.r_[True, (key[1:] != key[:-1]) | (source[1:] != source[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + size[:-1])]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(key)] - 1
        key, source, diagonal, a = key[first], source[first], diagonal[first], start[first].astype(np.int64)
        stop = start[last].astype(np.int64) + size[last]
        order = np.lexsort((a, source, key))
        key, source, diagonal, a, stop = (x[order] for x in (key, source, diagonal, a, stop))
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (source[1:] != source[:-1])])
        furthest = np.maximum.accumulate((group << 32) + stop) - (group << 32)
        begins = np.r_[True, (group[1:] != group[:-1]) | (a[1:] > furthest[:-1])]
        at = np.flatnonzero(begins)
        stretch = np.cumsum(begins) - 1
        b = a - diagonal
        longest = np.lexsort((a, a - stop, stretch))[at]
        end = np.maximum.reduceat(stop, at) + MIN_WORDS - 1
        n = end - a[at]
        ints = [a[at], end, np.minimum.reduceat(b, at), np.maximum.reduceat(b + stop - a, at) + MIN_WORDS - 1, n, (stop - a)[longest] + MIN_WORDS - 1, a[longest], b[longest]]
        ints = [pa.array(x.astype(np.int32)) for x in ints]
        columns = [pa.array(key[at]), *ints[:2], pa.array(source[at]), *ints[2:5], pa.array(np.ones(len(n))), *ints[5:]]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EXACT.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        other = np.flatnonzero(now[0] != now[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield done(*[x[:cut] for x in now])
    if held is not None:
        yield done(*held)


@lean
def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (key, start, stop descending, exact) in; exact ones that lie inside a span before them are left out."""
    key, furthest = None, -1
    for batch in batches:
        keep = []
        for k, stop, exact in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(8).to_pylist()):
            if k != key:
                key, furthest = k, -1
            keep.append(not exact or stop > furthest)
            furthest = max(furthest, stop)
        yield pa.RecordBatch.from_arrays(batch.columns[:8], batch.schema.names[:8]).filter(pa.array(keep, pa.bool_()))


def chain(d: np.ndarray, r: np.ndarray, rare: np.ndarray) -> list[np.ndarray]:
    """Chains of matches (places d in the document, r in the source; sorted by d, then r descending), best first."""
    n = len(d)
    if n == 1 or ((d[1:] > d[:-1]) & (r[1:] > r[:-1]) & (d[1:] - d[:-1] + r[1:] - r[:-1] < NEAR)).all():  # each adds to the one before
        return [np.arange(n)] if n >= MIN_SEEDS or rare[-1] else []
    ranks = np.searchsorted(np.unique(r), r) + 1
    size = int(ranks.max()) + 1
    tree_value, tree_at = [-1e18] * size, [-1] * size
    score, parent = [0.0] * n, [-1] * n
    dd, rr, kk = d.tolist(), r.tolist(), ranks.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and dd[j] == dd[i]:
            k, best, at = kk[j] - 1, -1e18, -1
            while k > 0:
                if tree_value[k] > best:
                    best, at = tree_value[k], tree_at[k]
                k -= k & -k
            best -= GAP_COST * (dd[j] + rr[j])
            score[j] = GAIN + max(best, 0.0)
            parent[j] = at if best > 0 else -1
            j += 1
        for m in range(i, j):  # matches at one place don't follow each other
            value, k = score[m] + GAP_COST * (dd[m] + rr[m]), kk[m]
            while k < size:
                if value > tree_value[k]:
                    tree_value[k], tree_at[k] = value, m
                k += k & -k
        i = j
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = parent[m]
        if len(path) >= MIN_SEEDS or (path and rare[path[0]]):
            out.append(np.array(path[::-1]))
    return out


def needed_sources(groups: list[list[int]]) -> list[int]:
    """Which of a document's sources are needed to span all places that match one; groups: the places of each, ascending."""
    spans = []
    for places in groups:
        own, start, last = [], places[0], places[0]
        for d in places[1:]:
            if d - last > SPAN_GAP:
                own.append((start // BIN, (last + SEED - 1) // BIN + 1))
                start = d
            last = d
        own.append((start // BIN, (last + SEED - 1) // BIN + 1))
        spans.append(own)
    covered = bytearray(max(own[-1][1] for own in spans))
    out = []
    for g in sorted(range(len(groups)), key=lambda g: (-sum(b - a for a, b in spans[g]), g)):
        if sum(covered[a:b].count(0) for a, b in spans[g]) >= NEW_BINS:
            out.append(g)
            for a, b in spans[g]:
                covered[a:b] = b"\1" * (b - a)
    return sorted(out)


@lean
def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, source, d, r descending, rare first) in, one row for each chain out. A document's rows are held together."""
    return _chained(batches, False)


@lean
def _all_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of all sources."""
    return _chained(batches, True)


def _chained(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    held = None

    def done(*columns) -> pa.RecordBatch:
        fresh = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:4]])]  # a match may come from several sides
        key, source, d, r, rare = (x[fresh] for x in columns)
        bounds = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (source[1:] != source[:-1]), True])
        groups = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b - a >= MIN_SEEDS or rare[a]]
        rows = []
        for k, mine in itertools.groupby(groups, key=lambda g: key[g[0]]):
            mine = list(mine)
            if len(mine) > 1 and not every:
                mine = [mine[g] for g in needed_sources([d[a:b].tolist() for a, b in mine])]
            for a, b in mine:
                for c in chain(d[a:b], r[a:b], rare[a:b]):
                    rows.append((int(k), int(source[a]), d[a:b][c].tolist(), r[a:b][c].tolist()))
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32())), pa.array(columns[3], pa.list_(pa.int32()))], ["key", "source", "d", "r"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        other = np.flatnonzero(now[0] != now[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield done(*[x[:cut] for x in now])
    if held is not None:
        yield done(*held)


def _words(keys: pa.Array, column: pa.Array) -> list[np.ndarray]:
    """The word hashes of each row's text, 32 bits each; rows of one key that follow each other share them."""
    keys = keys.to_numpy()
    fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    texts, found = fill(column).filter(pa.array(fresh)), []
    for start, stop in slices(texts):
        hashes, _, _, firsts = word_hashes(*flat(texts.slice(start, stop - start)))
        small = (hashes >> np.uint64(32)).astype(np.uint32)
        found += [small[a:b] for a, b in itertools.pairwise(firsts.tolist())]
    return [found[k] for k in (np.cumsum(fresh) - 1).tolist()]


@lean
def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = _words(batch.column(0), batch.column(3))
        got = [w[max(0, a - PAD) : b + PAD].tobytes() for w, a, b in zip(words, batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.binary())], ["source", "r_first", "r_last", "words"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


_SKIPS = [(x, s - x) for s in range(1, 7) for x in range(min(s, 3) + 1) if s - x <= 3]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, of b, equal ones) taken from the front: equal runs, with up to 3 words skipped before 4 equal ones."""
    i = j = equal = 0
    raw, other = a.tobytes(), b.tobytes()
    w = a.itemsize
    while True:
        run = _run(a[i:], b[j:])
        i, j, equal = i + run, j + run, equal + run
        n, m = len(a) - i, len(b) - j
        if not n or not m:
            return i, j, equal
        skip = next(((x, y) for x, y in _SKIPS if n - x >= 4 and m - y >= 4 and raw[(i + x) * w : (i + x + 4) * w] == other[(j + y) * w : (j + y + 4) * w]), None)
        if skip is None:
            return i, j, equal
        i, j = i + skip[0], j + skip[1]


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal words at the front."""
    n = min(len(a), len(b))
    if not n or a[0] != b[0]:
        return 0
    differs = a[:n] != b[:n]
    first = int(differs.argmax())
    return first if differs[first] else n


def _blocks(d: list[int], r: list[int], own: np.ndarray, theirs: np.ndarray) -> list[list[int]]:
    """(start, stop, source start, source stop) of the equal stretches of a chain, each as long as it gets."""
    out: list[list[int]] = []
    for i, j in zip(d, r):
        n = SEED
        if out:
            x, y = out[-1][1], out[-1][3]
            step = max(x - i, y - j, 0)  # overlaps what is aligned already
            i, j, n = i + step, j + step, n - step
            if n <= 0:
                continue
            same = _run(own[x:i], theirs[y:j])
            x, y = x + same, y + same
            out[-1][1], out[-1][3] = x, y
            back = _run(own[x:i][::-1], theirs[y:j][::-1])
            if (i - back, j - back) == (x, y):
                out[-1][1], out[-1][3] = i + n, j + n
                continue
            out.append([i - back, i + n, j - back, j + n])
        else:
            back = _run(own[:i][::-1], theirs[:j][::-1])
            out.append([i - back, i + n, j - back, j + n])
    same = _run(own[out[-1][1] :], theirs[out[-1][3] :])
    out[-1][1], out[-1][3] = out[-1][1] + same, out[-1][3] + same
    return out


def align(d: list[int], r: list[int], own: np.ndarray, theirs: np.ndarray, base: int) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, source start, source stop, equal words) of a chain's passages, from left to right.

    A stretch that lacks IDENTITY is cut at its gap of most unmatched words, and both sides are judged by themselves,
    down to the equal stretches. own: all words; theirs: words from base on.
    """
    b = np.array(_blocks(d, [x - base for x in r], own, theirs))
    gap = [_common(own[x:i], theirs[y:j]) for (x, y), (i, j) in zip(b[:-1, [1, 3]].tolist(), b[1:, [0, 2]].tolist())]
    lost = np.maximum(b[1:, 0] - b[:-1, 1], b[1:, 2] - b[:-1, 3]) - np.array(gap, np.int64)
    sums = np.concatenate([[0], np.cumsum((b[:, 1] - b[:, 0]) + np.array([0, *gap], np.int64))])
    out: list[tuple[int, int, int, int, int]] = []
    todo = [(0, len(b))]
    while todo:
        lo, hi = todo.pop()
        equal = int(sums[hi] - sums[lo]) - (gap[lo - 1] if lo else 0)
        (x, _, y, _), (_, i, _, j) = b[lo].tolist(), b[hi - 1].tolist()
        low, source_low = (b[lo - 1, 1], b[lo - 1, 3]) if lo else (0, 0)
        if out:
            low, source_low = max(low, out[-1][1]), max(source_low, out[-1][3] - base)
        high, source_high = (b[hi, 0], b[hi, 2]) if hi < len(b) else (len(own), len(theirs))
        back = _extend(own[max(low, x - PAD) : x][::-1], theirs[max(source_low, y - PAD) : y][::-1])
        front = _extend(own[i : min(high, i + PAD)], theirs[j : min(source_high, j + PAD)])
        wide = (x - back[0], i + front[0], y - back[1] + base, j + front[1] + base, equal + back[2] + front[2])
        passed = next((p for p in (wide, (x, i, y + base, j + base, equal)) if p[4] >= MIN_WORDS and p[4] >= IDENTITY * max(p[1] - p[0], p[3] - p[2])), None)
        if passed:
            out.append(passed)
        elif hi - lo > 1 and wide[4] >= MIN_WORDS:
            cut = lo + 1 + int(np.argmax(lost[lo : hi - 1]))
            todo += [(cut, hi), (lo, cut)]
    return out


@lean
def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _judged(batches, False)


@lean
def _aligned_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of rows sorted by key, less chains of which all places lie in one passage found before."""
    return _judged(batches, True)


def _judged(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    last, found = None, []
    for batch in batches:
        out = []
        names = ("key", "source", "d", "r", "words")
        for key, source, d, r, theirs, own in zip(*[batch.column(n).to_pylist() for n in names], _words(batch.column("key"), batch.column("text"))):
            if once:
                if key != last:
                    last, found = key, []
                if any(a <= d[0] and d[-1] + SEED <= b for a, b in found):
                    continue
            before = len(out)
            for a, b, c, e, equal in align(d, r, own, np.frombuffer(theirs, np.uint32), max(0, r[0] - PAD)):
                out.append((key, a, b, source, c, e, equal, equal / max(1, b - a, e - c)))
            found += [(x[1], x[2]) for x in out[before:] if once and not any(a <= x[1] and x[2] <= b for a, b in found)]
        columns = list(zip(*out)) or [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SPANS.split(", ")])


def _copies(plain: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(documents less all but the first of equal texts, SPANS of the others)."""
    signed = work.save(plain.select("id", F.unhex(F.md5("text")).alias("digest")), "signed")
    firsts = work.save(signed.groupBy("digest").agg(F.min("id").alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    copies = work.save(signed.join(firsts, "digest").where("id <> source").select("id", "source"), "copies")
    work.drop("signed")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    n = F.when(F.col("source").isNotNull(), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")  # source keeps the filter on it behind the join
    sized = plain.join(few, "id").select("id", "source", n).where(F.col("n") >= MIN_WORDS)
    zero = F.lit(0)
    spans = sized.select(F.col("id").alias("key"), zero.alias("start"), F.col("n").alias("stop"), "source", zero.alias("source_start"), F.col("n").alias("source_stop"), F.col("n").alias("n_equal"), F.lit(1.0).alias("identity"))
    return plain.join(few, "id", "left_anti"), spans


def find_passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Passages that repeat one of a document with a smaller key: SPANS, in words (stop is behind the last word), and version."""
    work = Workspace(docs.sparkSession, "passages")
    plain, names = numbered(docs, key, text, work)
    plain, copies = _copies(plain.where(F.col("text").isNotNull()), work)
    plain = plain.withColumnRenamed("id", "key")
    seeds = work.save(plain.mapInArrow(_seeds, SEEDS), "seeds")
    firsts = seeds.where("first").groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("source"), F.min_by("pos", "key").alias("r"))
    sources = work.save(firsts.where("c > 1").withColumn("c", F.col("c").cast("int")), "sources")  # a table: a join to an aggregate can't be split where skewed
    met = work.save(seeds.join(sources.hint("shuffle_hash"), "seed"), "met")  # a row for each seed: no need to sort the others
    work.drop("seeds", "sources")
    exact = _exact(work, plain, met.where("n > 0"))
    two = lambda at, more: F.explode(F.array(*[F.struct((F.col(at[0]) + m).alias("d"), (F.col(at[1]) + m).alias("r")) for m in more]))
    others = met.where(F.col("key") != F.col("source"))
    rare = F.col("c") <= RARE
    narrow = others.where("n = 0").select("key", "source", F.col("pos").alias("d"), "r", rare.alias("rare"))
    crowd = F.pmod(F.xxhash64("key"), F.floor(F.col("c") / CROWD) + 1)
    held = met.where("n = 0 and first and c > 2").select("seed", crowd.alias("crowd"), "key", "source", "pos", "c")  # of two holders the one before is the first
    before = Window.partitionBy("seed", "crowd").orderBy("key")
    nearest = held.select("key", F.col("source").alias("least"), F.lag("key").over(before).alias("source"), F.col("pos").alias("d"), F.lag("pos").over(before).alias("r"), rare.alias("rare"))
    nearest = nearest.where(F.col("source") != F.col("least")).drop("least")
    # An anchor (at its first place in a document) is two seeds, an equal run one at every STEP words and at its end.
    anchors = others.where("n > 0 and first").select("key", "source", two(("pos", "r"), (0, ANCHOR - SEED)).alias("x"))
    steps = F.array_union(F.sequence(F.lit(0), F.col("run") - SEED, F.lit(STEP)), F.array(F.col("run") - SEED))
    runs = exact.select("key", "source", "run_start", "run_source", F.explode(steps).alias("m")).select("key", "source", F.struct((F.col("run_start") + F.col("m")).alias("d"), (F.col("run_source") + F.col("m")).alias("r")).alias("x"))
    no = F.lit(False)
    matches = narrow.union(nearest).union(anchors.select("key", "source", "x.d", "x.r", no)).union(runs.select("key", "source", "x.d", "x.r", no))
    ordered = matches.repartition("key").sortWithinPartitions("key", "source", "d", F.desc("r"), F.desc("rare"))
    chains = work.save(ordered.mapInArrow(_chains, CHAINS), "chains")
    both = _passages(work, plain, chains).withColumn("exact", F.lit(False)).union(exact.drop("run", "run_start", "run_source").withColumn("exact", F.lit(True)))
    tried = work.save(_largest(both), "tried")
    work.drop("exact", "chains", "texts")
    out = _rest(work, plain, met, tried).union(copies)
    if names is None:
        out = out.withColumn("version", F.lit(None).cast("long"))
    else:
        mine = names.select(F.col("id").alias("_i"), F.col("key").alias("_key"), "version")
        theirs = names.select(F.col("id").alias("_j"), F.col("key").alias("_source"))
        out = out.join(mine, F.col("key") == F.col("_i")).join(theirs, F.col("source") == F.col("_j"))
        out = out.withColumns({"key": F.col("_key"), "source": F.col("_source")}).drop("_i", "_j", "_key", "_source")
    out = work.save(out.select([x.split()[0] for x in SPANS.split(", ")] + ["version"]), "spans")
    work.drop("firsts", "copies", "met", "tried", "more", "texts", "names", "rows")
    return out


def _passages(work: Workspace, plain: DataFrame, chains: DataFrame, once: bool = False) -> DataFrame:
    """SPANS of the passages of chains; the texts of their documents are written. once: longest chains first, a place needs one passage."""
    chains = chains.withColumns({"r_first": F.get("r", F.lit(0)), "r_last": F.element_at("r", -1)})
    keys = chains.select(F.explode(F.array("key", "source")).alias("key")).distinct()
    needed = work.save(texts_of(plain, keys), "texts")
    asked = chains.select(F.col("source").alias("key"), "r_first", "r_last").distinct().join(needed, "key").select("key", "r_first", "r_last", "text")
    regions = asked.mapInArrow(_regions, "source long, r_first int, r_last int, words binary")
    both = chains.join(regions, ["source", "r_first", "r_last"]).join(needed, "key").select("key", "source", "d", "r", "words", "text")
    if once:
        both = both.repartition("key").sortWithinPartitions("key", F.desc(F.size("d")), "source")
    return both.mapInArrow(_aligned_once if once else _aligned, SPANS)


def _largest(spans: DataFrame) -> DataFrame:
    """SPANS (and exact) less the exact ones inside others."""
    return spans.repartition("key").sortWithinPartitions("key", "start", F.desc("stop"), "exact").mapInArrow(_uncovered, SPANS)


def _rest(work: Workspace, plain: DataFrame, met: DataFrame, tried: DataFrame) -> DataFrame:
    """tried and the passages of open seeds with any earlier document."""
    places = work.save(_places(met, tried), "places")
    around = work.save(_around(work, plain, places), "around")
    pairs = work.save(_linked(around).union(_alone(around)), "pairs")
    chains = work.save(_shared(around, pairs).mapInArrow(_all_chains, CHAINS), "more")
    work.drop("places", "lists", "around", "pairs")
    found = _passages(work, plain, chains, True)
    return _largest(tried.withColumn("exact", F.lit(False)).union(found.withColumn("exact", F.lit(True))))


def _places(met: DataFrame, spans: DataFrame) -> DataFrame:
    """The seeds that documents share, and which of their places are open: in no span, and held by more than RARE documents."""
    seeds = met.where("n = 0").select("key", "seed", "pos", "c", F.lit(0).alias("stop"))
    both = seeds.union(spans.select("key", F.lit(0).cast("long"), "start", F.lit(0), "stop"))  # at one place spans come first
    reached = F.max("stop").over(Window.partitionBy("key").orderBy("pos", "c"))
    return both.select("key", "seed", "pos", "c", ((F.col("c") > RARE) & (F.col("pos") + SEED > reached)).alias("open")).where("c > 0").drop("c")


AROUNDS = "kind int, id long, key long, pos int, gap int, mine boolean, between long, words binary"
PLACE, LINK, CONTEXT = range(3)


def _ends(words: np.ndarray, firsts: np.ndarray, seed: np.ndarray, pos: np.ndarray, *flags: np.ndarray) -> list[np.ndarray]:
    """(stretch, seed, pos, flags) of places, by pos, in texts that begin at firsts. A place in a stretch that repeats fewer than SEED words becomes the seed's first and last one there; stretch: its start, else -1.

    They stand for all: texts that share a part of such a stretch are equal from one of its ends on, or have less in common than that part.
    """
    first, last, stretch = pos.copy(), pos.copy(), np.full(len(pos), -1)
    for step in range(1, SEED):
        at = np.flatnonzero(stretch < 0)
        for n in range(SEED - step):
            at = at[words[pos[at] + n] == words[pos[at] + n + step]]
        if not len(at):
            continue
        ends = np.r_[words[:-step] != words[step:], np.ones(step, bool)]
        last_words = firsts[1:, None] - np.arange(1, step + 1)
        ends[last_words[last_words >= 0]] = True
        ends = np.flatnonzero(ends)
        behind = np.searchsorted(ends, pos[at])
        start, stop = np.where(behind > 0, ends[behind - 1] + 1, 0), ends[behind] + step
        if step > SEED // 2:  # the seed alone doesn't say that it is repeated
            more = stop - start >= SEED + step
            at, start, stop = at[more], start[more], stop[more]
        first[at], last[at], stretch[at] = pos[at] - (pos[at] - start) // step * step, pos[at] + (stop - SEED - pos[at]) // step * step, start
    at, which = np.unique(np.r_[first, last], return_index=True)
    which %= len(pos)
    of = np.searchsorted(at, np.r_[first, last])
    out = [stretch[which], seed[which], at]
    for flag in flags:
        held = np.zeros(len(at), bool)
        held[of[np.r_[flag, flag]]] = True
        out.append(held)
    return out


@lean
def _arounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, seeds (seed, pos, open, asked) in, AROUNDS out. Places are counted over all texts of a slice."""
    width = 2 * AROUND + SEED
    fields = [x.split()[0] for x in AROUNDS.split(", ")]
    for batch in batches:
        texts = fill(batch.column(1))
        for begin, end in slices(texts):
            words, _, _, firsts = word_hashes(*flat(texts.slice(begin, end - begin)))
            keys = batch.column(0).slice(begin, end - begin)
            text, columns = _listed(batch.column(2), begin, end)
            all_seeds, all_pos, *flags = (x.to_numpy(zero_copy_only=False) for x in columns)
            all_pos = all_pos + firsts[text]
            stretch, seed, pos, is_open, asked = _ends(words, firsts, all_seeds, all_pos, *flags)
            doc = np.searchsorted(firsts, pos, side="right") - 1
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * powers(len(words)), out=sums[1:])

            def rows(kind, ids, doc, pos, gap, mine, between, around=None):
                n = len(ids)
                ints = [np.full(n, kind), pos - firsts[doc], gap]
                kind, pos, gap = (pa.array(x.astype(np.int32)) for x in ints)
                if around is None:
                    held = pa.nulls(n, pa.binary())
                else:
                    held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (4 * width)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                return pa.RecordBatch.from_arrays([kind, pa.array(ids), keys.take(pa.array(doc)), pos, gap, pa.array(mine), pa.array(between), held], fields)

            low, high = np.maximum(pos - NEAR, firsts[doc])[is_open], np.minimum(pos + NEAR, firsts[doc + 1])[is_open]
            near = np.cumsum(np.bincount(low, minlength=len(words) + 1) - np.bincount(high, minlength=len(words) + 1)) > 0
            kept = np.zeros(len(words) + 1, bool)
            kept[pos] = True
            more = ~kept[all_pos]  # inside of stretches: places of passages, not of their sources
            at = np.r_[pos, all_pos[more]]
            n = len(at)
            yield rows(PLACE, np.r_[seed, all_seeds[more]], np.r_[doc, text[more]], at, (np.arange(n) < len(pos)), near[at], np.zeros(n, np.int64))

            apart = pos + doc * NEAR  # places of two texts are never near
            at, pairs, step = np.arange(len(pos)), [np.zeros((2, 0), np.int64)], 1
            while len(at := at[at + step < len(pos)]) and len(at := at[apart[at + step] - apart[at] < NEAR]):
                i = at[asked[at] | asked[at + step]]
                pairs.append(np.array([i, i + step]))
                step += 1
            i, j = np.concatenate(pairs, axis=1)
            short = (stretch[i] >= 0) & (stretch[i] == stretch[j]) & (pos[j] - pos[i] + SEED < MIN_WORDS)  # no passage by itself
            i, j = i[~short], j[~short]
            between = mix((sums[pos[j] + SEED] - sums[pos[i]]) * powers(len(words), True)[pos[i]]).view(np.int64)
            link = mix(seed[i].view(np.uint64) + mix(seed[j].view(np.uint64))).view(np.int64)
            mine = is_open[i] | is_open[j]
            order = np.lexsort((~mine, between, link, doc[i]))
            at = order[_new(between[order], link[order], doc[i][order])]
            yield rows(LINK, link[at], doc[i[at]], pos[i[at]], pos[j[at]] - pos[i[at]], mine[at], between[at])

            at = np.flatnonzero(asked)
            small = (words >> np.uint64(32)).astype(np.uint32)
            small[small == 0] = 1  # 0 is what lies outside
            gap = AROUND + SEED
            padded = np.zeros(len(words) + len(firsts) * gap + AROUND, np.uint32)
            padded[np.arange(len(words)) + AROUND + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)) * gap] = small
            around = np.lib.stride_tricks.sliding_window_view(padded, width)[pos[at] + doc[at] * gap]  # it holds the seed
            digest = sum(around[:, n].astype(np.uint64) * powers(width)[n] for n in range(width))
            order = np.lexsort((~is_open[at], digest, doc[at]))
            at, around = at[order], around[order]
            fresh = _new(doc[at]) | np.r_[True, (around[1:] != around[:-1]).any(1)][: len(at)]
            at = at[fresh]
            n = len(at)
            yield rows(CONTEXT, seed[at], doc[at], pos[at], np.zeros(n), is_open[at], np.zeros(n, np.int64), around[fresh])


def _around(work: Workspace, plain: DataFrame, places: DataFrame) -> DataFrame:
    """AROUNDS of the documents that hold an open seed or share one: places, links and the words around seeds that are open somewhere.

    mine: open in this document. Equal links and contexts of a document stand once.
    """
    asked = places.where("open").select("seed").distinct().withColumn("asked", F.lit(True))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_SEEDS else asked
    marked = places.join(asked, "seed", "left").select("key", F.struct("seed", "pos", "open", F.coalesce("asked", F.lit(False)).alias("asked")).alias("x"))
    lists = marked.groupBy("key").agg(F.collect_list("x").alias("seeds")).where(F.exists("seeds", lambda x: x["asked"]))
    lists = work.save(lists, "lists")
    return texts_of(plain, lists.select("key")).join(lists, "key").select("key", "text", "seeds").mapInArrow(_arounds, AROUNDS)


PAIRS = "key long, source long, d int, r int"


def _linked(around: DataFrame) -> DataFrame:
    """PAIRS (d, r: null) of documents and earlier ones with a link of theirs, of which a seed is open, and other words between."""
    links = around.where(F.col("kind") == LINK).select(F.col("id").alias("link"), "key", "gap", "mine", "between")
    several = links.groupBy("link").agg(F.min("between").alias("a"), F.max("between").alias("b"), F.bool_or("mine").alias("mine")).where("mine and a <> b").select("link")
    links = links.join(several, "link", "left_semi")
    theirs = links.select("link", F.col("key").alias("source"), F.col("gap").alias("r_gap"), F.col("between").alias("others"))
    both = links.where("mine").join(theirs, "link").where((F.col("source") < F.col("key")) & (F.col("between") != F.col("others")) & (F.col("gap") + F.col("r_gap") <= NEAR))
    no = F.lit(None).cast("int")
    return both.select("key", "source").distinct().select("key", "source", no.alias("d"), no.alias("r"))


def going_on(seed: np.ndarray, words: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): mine[i], of one seed with j, and the equal run of the words around both goes on behind a skip by 4 equal words.

    Rows are sorted by their words on one side of the seed, so those of equal first words are neighbours. Where they
    branch, rows meet by the 4 words that come 0 to 3 words behind the branch, so rows that share a run and nothing more
    are never compared.
    """
    found = []
    for side, least in ((words[:, AROUND:], SEED), (words[:, AROUND - 1 :: -1], 0)):
        side = np.ascontiguousarray(side)
        width = side.shape[1]
        order = np.lexsort((np.unique(side.view(np.dtype((np.void, 4 * width))).ravel(), return_inverse=True)[1], seed))
        s, m = side[order], mine[order]
        differs = np.concatenate([s[1:] != s[:-1], np.ones((max(0, len(s) - 1), 1), bool)], axis=1)
        common = np.r_[-1, np.where(seed[order[1:]] == seed[order[:-1]], differs.argmax(1), -1)]
        gram = mix(sum(s[:, n : width - 3 + n].astype(np.uint64) * powers(5)[n + 1] for n in range(4)))
        for depth in range(least, width - 3):
            if not (common == depth).any():
                continue
            node = np.cumsum(common < depth) - 1
            branches = np.zeros(node[-1] + 1, bool)
            branches[node[common == depth]] = True
            has = np.zeros(len(branches), bool)
            has[node[m]] = True
            rows = np.flatnonzero((branches & has)[node] & (s[:, depth] != 0))
            skips = [(rows[ok], gram[rows[ok], depth + x]) for x in range(4) if depth + x < width - 3 and (ok := (s[rows, depth + x : depth + x + 4] != 0).all(1)) is not None]
            row, key = (np.concatenate(x) for x in zip(*skips))
            if not len(row):
                continue
            key = mix(key + mix(node[row].astype(np.uint64)))
            by = np.lexsort((s[row, depth], key))
            row, key, next_word = row[by], key[by], s[row[by], depth]
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            stop = np.r_[start[1:], len(key)]
            asks = np.flatnonzero(m[row] & (next_word[start] != next_word[stop - 1])[group])
            n = (stop - start)[group[asks]]
            a = np.repeat(asks, n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[asks]], n)
            good = next_word[a] != next_word[b]
            found.append((order[row[a[good]]], order[row[b[good]]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    both = np.unique(i * len(seed) + j)
    return both // len(seed), both % len(seed)


def may_pass(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the words around a seed, on both sides, have MIN_WORDS equal ones behind skips, or go on to where they are cut off."""
    equal = 0
    for x, y in ((a[AROUND:], b[AROUND:]), (a[AROUND - 1 :: -1], b[AROUND - 1 :: -1])):
        i, j, n = _extend(*(z[: (z == 0).argmax()] if (z == 0).any() else z for z in (x, y)))
        if max(i, j) > len(x) - 8:
            return True
        equal += n
    return equal >= MIN_WORDS


@lean
def _met_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (seed, i, j, side, key, pos, words), sorted, in; PAIRS that may make a passage out. side: 1 mine, 2 theirs, 3 both."""
    held = None

    def done(rows: pa.Table) -> pa.RecordBatch:
        seed, i, j, side, key, pos = (rows.column(c).to_numpy() for c in range(6))
        block = np.cumsum(np.r_[True, (seed[1:] != seed[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        words = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint32).reshape(len(seed), -1)
        kinds = np.ascontiguousarray(np.column_stack([block.astype(np.uint32), words]))
        _, first, kind = np.unique(kinds.view(np.dtype((np.void, 4 * kinds.shape[1]))).ravel(), return_index=True, return_inverse=True)
        asks = np.zeros(len(first), bool)
        asks[kind[side & 1 > 0]] = True
        own, other = going_on(block[first], words[first], asks)
        good = np.array([may_pass(words[first[x]], words[first[y]]) for x, y in zip(own, other)], bool)
        own, other = own[good], other[good]
        # Documents with equal words around a seed are one source, the earliest of them.
        least = np.full(len(first), -1)
        theirs = np.flatnonzero(side & 2 > 0)
        theirs = theirs[np.lexsort((key[theirs], kind[theirs]))][::-1]
        least[kind[theirs]] = theirs
        mine = np.flatnonzero(side & 1 > 0)
        mine = mine[np.argsort(kind[mine], kind="stable")]
        start, stop = (np.searchsorted(kind[mine], own, side=x) for x in ("left", "right"))
        n = stop - start
        a = mine[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        b = np.repeat(least[other], n)
        good = (b >= 0) & (key[b] < key[a])
        a, b = a[good], b[good]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[a], key[b], pos[a], pos[b])], ["key", "source", "d", "r"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        names = [held.column(c).to_numpy() for c in range(3)]
        other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in names]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield done(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield done(held)


def _alone(around: DataFrame) -> DataFrame:
    """PAIRS of single matches of open seeds with all earlier documents that may make a passage."""
    rows = around.where(F.col("kind") == CONTEXT).select(F.col("id").alias("seed"), "key", "pos", "mine", "words")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = rows.groupBy("seed").agg(F.count_if("mine").alias("a"), F.count(F.lit(1)).alias("b")).select("seed", parts("a").alias("a"), parts("b").alias("b")).where("a > 0")
    own = lambda n: F.pmod(F.xxhash64("key", "pos"), F.col(n)).cast("int")
    blocks = F.array_union(F.when(F.col("mine"), F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda x: F.struct(own("a").alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")), F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda x: F.struct(x.alias("i"), own("b").alias("j"))))
    dealt = rows.join(sizes, "seed").withColumn("x", F.explode(blocks))
    as_mine, as_theirs = F.col("mine") & (F.col("x.i") == own("a")), F.col("x.j") == own("b")
    dealt = dealt.select("seed", "x.i", "x.j", (as_mine.cast("int") + 2 * as_theirs.cast("int")).alias("side"), "key", "pos", "words")
    return dealt.repartition("seed", "i", "j").sortWithinPartitions("seed", "i", "j").mapInArrow(_met_around, PAIRS)


def _shared(around: DataFrame, pairs: DataFrame) -> DataFrame:
    """All matches of PAIRS near open places, those of _alone as rare, sorted for _all_chains."""
    places = around.where(F.col("kind") == PLACE).select("key", F.col("id").alias("seed"), "pos", "mine", "gap")
    asked = pairs.select("key", "source").distinct()
    own = asked.join(places.where("mine"), "key").select("key", "source", "seed", F.col("pos").alias("d"))
    theirs = places.where("gap = 1").select(F.col("key").alias("source"), "seed", F.col("pos").alias("r"))
    matches = own.join(theirs, ["source", "seed"]).select("key", "source", "d", "r", F.lit(False).alias("rare"))
    matches = matches.union(pairs.where("d is not null").select("key", "source", "d", "r", F.lit(True)))
    return matches.repartition("key").sortWithinPartitions("key", "source", "d", F.desc("r"), F.desc("rare"))


def _exact(work: Workspace, plain: DataFrame, anchors: DataFrame) -> DataFrame:
    """EXACT of all runs of MIN_WORDS words or more that a document of a smaller key holds, by its first such document."""
    segment = ["seed", "digest", "n"]
    segments = anchors.groupBy(*segment).agg(F.min(F.struct("key", "pos")).alias("at"), F.min("off").alias("off"), F.count(F.lit(1)).alias("times"))
    segments = work.save(segments.select(*segment, F.col("at.key").alias("key"), (F.col("at.pos") - F.col("off")).alias("lo"), "times"), "segments")
    several = work.save(segments.groupBy("seed").count().where("count > 1").select("seed"), "several")
    alone = segments.join(several, "seed", "left_anti").where("times > 1")
    alone = alone.select(*segment, F.lit(0).alias("i"), F.col("n").alias("size"), F.col("key").alias("source"), F.col("lo").alias("r"))
    lists = segments.join(several, "seed", "left_semi").groupBy("key").agg(F.collect_list(F.struct(*segment, "lo", "times")).alias("segments"))
    texts = texts_of(plain, lists.select("key")).join(lists, "key").select("key", "text", "segments")
    windows = work.save(texts.mapInArrow(_windows, WINDOWS), "windows")
    held = windows.groupBy("window").agg(F.min(F.struct("key", "pos")).alias("least"))
    held = work.save(held.select("window", F.col("least.key").alias("source"), F.col("least.pos").alias("r")), "held")
    found = windows.join(held, "window").where((F.col("times") > 1) | (F.col("key") != F.col("source")))
    lists = found.groupBy(*segment).agg(F.collect_list(F.struct("i", "source", "r")).alias("held"))  # as many as an anchor owns windows
    intervals = work.save(lists.mapInArrow(_intervals, INTERVALS).union(alone), "intervals")
    pieces = anchors.select(*segment, "key", (F.col("pos") - F.col("off")).alias("lo")).join(intervals, segment).where(F.col("key") != F.col("source"))
    start = F.col("lo") + F.col("i")
    pieces = pieces.select("key", "source", (start - F.col("r")).alias("diagonal"), start.alias("start"), "size")
    runs = work.save(pieces.repartition("key").sortWithinPartitions("key", "source", "diagonal", "start").mapInArrow(_merged, EXACT), "exact")
    work.drop("segments", "several", "windows", "held", "intervals")
    return runs


def remove_passages(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """docs with the words of spans (and the white space behind them) taken out of text; texts left without a word go."""
    own = spans.groupBy(F.col("key").alias("_key"), F.col("version").alias("_version")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    own = F.broadcast(own) if spans.count() <= BROADCAST_SPANS else own
    same = F.col("_version").isNull() | (version_of(F.col(text)) == F.col("_version"))  # of rows that share a key only those with that text
    joined = docs.join(own, F.col(key).cast("long").eqNullSafe(F.col("_key")) & same, "left")
    clean, cut = joined.where(F.col("_spans").isNull()).select(docs.columns), joined.where(F.col("_spans").isNotNull())
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = fill(batch.column(at)).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            left = [_without(t, [(s["start"], s["stop"]) for s in x]) for t, x in zip(texts, lists)]
            columns = [pa.array(left, pa.string()) if i == at else batch.column(i) for i in range(len(schema))]
            keep = pa.array([bool(t.strip(" \t\n\x0b\f\r")) for t in left])
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(keep)

    return clean.union(cut.select(*docs.columns, "_spans").mapInArrow(run, schema))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, offsets = flat(pa.array([text]))
    _, starts, _, _ = word_hashes(raw, offsets)
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in spans:
        gone[min(a, len(starts))] += 1
        gone[min(b, len(starts))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    ends = np.r_[starts[1:], len(raw)]
    mask = np.ones(len(raw), bool)
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, starts[~keep], 1)
    np.add.at(edges, ends[~keep], -1)
    mask = np.cumsum(edges[:-1]) == 0
    return raw[mask].tobytes().decode()
