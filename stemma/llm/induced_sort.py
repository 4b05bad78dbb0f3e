"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than the next one. Leftmost-smaller (LMS) substrings are sorted by a pair
of induced passes and named; if names repeat, the string of names is sorted in turn by the same method, whatever its
alphabet. The order of LMS suffixes then induces the whole array by a second pair of passes.

A pass goes over the array once, in batches: the entries from the scan's place up to the first slot that any of them
fills have all been written, so they induce their predecessors at once. Each suffix is induced once in a pass, so a
pass is linear in the text; batches are as long as a bucket where the alphabet is small, and about the root of the
text's length where it is large, so no pass loops over the alphabet.
"""

from __future__ import annotations

import numpy as np

LEAST_BATCH, MOST_BATCH = 64, 1 << 17
PREFIX_CAP = 400  # common prefixes are told up to this length


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller."""
    n = len(t)
    up, level = t[:-1] < t[1:], t[:-1] == t[1:]
    # Equal symbols take the type of the next place where symbols differ.
    at = np.where(level, n, np.arange(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = np.r_[up, False][np.minimum(at, n - 1)]
    return s


def _scan(a: np.ndarray, t: np.ndarray, wanted: np.ndarray, fill: np.ndarray) -> None:
    """Goes up the array a and puts the wanted predecessors of its entries at their symbols' next slots (fill).

    a: places, or -1 for a slot that is free. Predecessors go behind the entries that induce them.
    """
    i, n, width = 0, len(a), LEAST_BATCH
    while i < n:
        stop = min(i + width, n)
        entries = a[i:stop]
        x = np.flatnonzero(entries > 0)
        pred = entries[x] - 1
        good = wanted[pred]
        x, pred = x[good], pred[good]
        if len(x):
            symbols = t[pred]
            slots = fill[symbols]
            low = np.minimum.accumulate(slots)
            late = x[1:] + i >= low[:-1]
            m = int(late.argmax()) + 1 if late.any() else len(x)
            stop = min(stop, int(low[m - 1]))
            if m == 1:
                a[slots[0]] = pred[0]
                fill[symbols[0]] += 1
            else:
                order = np.argsort(symbols[:m], kind="stable")  # a radix sort for 16-bit symbols
                ordered = symbols[order]
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                sizes = np.diff(np.r_[starts, m])
                a[slots[order] + np.arange(m) - np.repeat(starts, sizes)] = pred[order]
                fill[ordered[starts]] += sizes
        width = min(max(2 * (stop - i), LEAST_BATCH), MOST_BATCH)
        i = stop


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array from LMS suffixes in the given order (by first symbol at least)."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=k))
    lms_ends = np.cumsum(np.bincount(t[lms], minlength=k))
    symbol = t[lms]
    at = ends[symbol] - lms_ends[symbol] + np.arange(len(lms))
    sa = np.full(n, -1, np.int32)
    sa[at] = lms
    _scan(sa, t, ~s, np.r_[0, ends[:-1]])
    sa[at] = -1  # smaller suffixes are put in anew, from the ends of their buckets
    sa[0] = n - 1
    back = n - ends
    back[t[-1]] += 1
    _scan(sa[::-1], t, s, back)
    return sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """t: symbols below k, of which the last is 0 and occurs there alone."""
    n = len(t)
    t = t.astype(np.uint16 if k < 1 << 16 else np.int32)
    if n == 1:
        return np.zeros(1, np.int64)
    s = _types(t)
    is_lms = np.r_[False, s[1:] & ~s[:-1]]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, s, lms[np.argsort(t[lms], kind="stable")], k)
    ordered = sa[is_lms[sa]]
    lengths = np.r_[np.diff(lms) + 1, 1]
    length_at = np.zeros(n, np.int64)
    length_at[lms] = lengths
    size = length_at[ordered]
    same = np.r_[False, size[1:] == size[:-1]]
    pairs = np.flatnonzero(same)
    if len(pairs):  # compare neighbours of one length symbol by symbol
        width = size[pairs]
        stop = np.cumsum(width)
        inside = np.arange(stop[-1]) - np.repeat(stop - width, width)
        equal = t[np.repeat(ordered[pairs], width) + inside] == t[np.repeat(ordered[pairs - 1], width) + inside]
        same[pairs] = np.logical_and.reduceat(equal, stop - width)
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(lms):
        # A name that occurs once ends a comparison, so of several in a row only the first is needed.
        often = np.bincount(names)[names] > 1
        name_at, often_at = np.zeros(n, np.int32), np.zeros(n, bool)
        name_at[ordered], often_at[ordered] = names, often
        repeats = often_at[lms]
        needed = repeats.copy()
        needed[1:] |= repeats[:-1]
        needed[-1] = True
        left = lms[needed]
        _, reduced = np.unique(name_at[left], return_inverse=True)
        deeper = left[suffix_array(reduced.astype(np.int32), int(reduced.max()) + 1)]
        ordered[often] = deeper[often_at[deeper]]
    return _induce(t, s, ordered, k)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): for each suffix the one before it in the array (-1: none) and their common prefix.

    Comparison stops at PREFIX_CAP symbols, so a place that is d behind the last compared one is told PREFIX_CAP - d
    at most. fresh: places that are compared in any case, so that d stays small where the caller needs it.

    Where both left neighbours are equal and neighbours in the array as well, the length is one less than that of
    the suffix before; only the others are compared, eight symbols at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] >= 1) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (t[:-1] == t[np.maximum(before[:-1], 0)])
    if fresh is not None:
        follows[fresh] = False
    heads = np.flatnonzero(~follows & (before >= 0))
    padded = np.zeros(n + PREFIX_CAP + 16, np.uint16)
    padded[:n] = t + 1
    length = np.zeros(n, np.int64)
    alive, other, at = heads, before[heads], 0
    block = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(alive) and at < PREFIX_CAP:
        differs = block[alive + at] != block[np.minimum(other + at, len(block) - 1)]
        any_differs = differs.any(axis=1)
        length[alive] = at + np.where(any_differs, differs.argmax(axis=1), 8)
        alive, other, at = alive[~any_differs], other[~any_differs], at + 8
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(~follows, place, 0))
    length = np.maximum(length[last] - (place - last), 0)
    length[before < 0] = 0
    return before, length
