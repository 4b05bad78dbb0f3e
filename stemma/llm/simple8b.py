"""Simple-8b coding of unsigned integers in 64-bit words, vectorised over blocks.

The top four bits of a word are its selector. Selectors 1 to 14 pack COUNTS[s] values of WIDTHS[s] bits each, the
first value lowest. Selector 0 is an escape: the word stands for one value of more than 60 bits, which lies in a
list of its own. Values are coded in blocks of BLOCK values that begin on a word of their own, so that any block is
decoded alone. A word at a block's end may have unused places, which are zero; the block's count tells how many
values are real.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 1024
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PAD = 64
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = np.maximum(np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right"), 1).astype(np.uint8)


class Coded(NamedTuple):
    words: np.ndarray  # uint64
    word_ends: np.ndarray  # offset of each block's first word, and the end
    escapes: np.ndarray  # uint64
    escape_ends: np.ndarray  # the same for escapes


def _bits(values: np.ndarray) -> np.ndarray:
    if values.max() < 1 << 16:
        return _SMALL[values.astype(np.int64)]
    return np.maximum(np.searchsorted(_POWERS, values, side="right"), 1).astype(np.uint8)


def encode(values: np.ndarray) -> Coded:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return Coded(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64))
    blocks = -(-n // BLOCK)
    row = BLOCK + PAD
    bits, held = np.ones((blocks, row), np.uint8), np.zeros((blocks, row), np.uint64)
    full = n // BLOCK
    for padded, own in ((bits, _bits(values)), (held, values)):
        padded[:full, :BLOCK] = own[: full * BLOCK].reshape(full, BLOCK)
        if full < blocks:
            padded[full, : n - full * BLOCK] = own[full * BLOCK :]
    most = {1: bits.ravel()}  # most[k][i]: widest of the k values from i
    for k in (2, 4, 8, 16, 32):
        half = most[k // 2]
        most[k] = half.copy()
        np.maximum(half[: -(k // 2)], half[k // 2 :], out=most[k][: -(k // 2)])
    best = np.zeros(blocks * row, np.uint8)  # the selector of a word that begins at a place; no word begins in the last PAD
    for s in range(14, 0, -1):
        count = int(COUNTS[s])
        k = 1 << (count.bit_length() - 1)
        size = len(best) - (count - k)
        best[:size][np.maximum(most[k][:size], most[k][count - k :]) <= WIDTHS[s]] = s
    room = np.full(blocks, BLOCK)
    room[-1] = n - (blocks - 1) * BLOCK
    pos, alive = np.zeros(blocks, np.int64), np.arange(blocks)
    chain = []
    while len(alive):
        sel = best[alive * row + pos[alive]]
        chain.append((alive, pos[alive], sel))
        pos[alive] += COUNTS[sel]
        alive = alive[pos[alive] < room[alive]]
    block, first, sel = (np.concatenate(x) for x in zip(*chain))
    order = np.lexsort((first, block))
    block, first, sel = block[order], first[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    held, flat_at = held.ravel(), block * row + first
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            at, packed = flat_at[mine], words[mine]
            for j in range(int(COUNTS[s])):
                packed |= held[at + j] << np.uint64(j * int(WIDTHS[s]))
            words[mine] = packed
    odd = sel == 0
    ends = lambda of: np.r_[0, np.cumsum(np.bincount(of, minlength=blocks))]
    return Coded(words, ends(block), held[flat_at[odd]], ends(block[odd]))


def decode(words: np.ndarray, escapes: np.ndarray, word_ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of whole blocks, of which counts tells the numbers of values; words and escapes are theirs alone."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    size = COUNTS[sel]
    slots = np.r_[0, np.cumsum(size)]
    # The last word of a block may have unused places; they are taken off again.
    over = (slots[word_ends[1:]] - slots[word_ends[:-1]]) - counts
    size[word_ends[1:][over > 0] - 1] -= over[over > 0]
    starts = np.cumsum(size) - size
    out = np.zeros(total, np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s]) if len(mine) else 0):
            real = mine[j < size[mine]]
            out[starts[real] + j] = (words[real] >> np.uint64(j * int(WIDTHS[s]))) & mask
    out[starts[sel == 0]] = escapes
    return out
