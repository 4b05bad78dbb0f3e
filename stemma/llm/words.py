"""Word hashes of texts, vectorised: words are runs of [^\\x20\\x09-\\x0D], with A to Z in lower case."""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _VALUE[_c] = _VALUE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base ** i (or its inverse) modulo 2**64, for i below n at least."""
    name = "inverse" if inverse else "base"
    if len(_powers.get(name, ())) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    start[inner] = solid[inner]
    starts = np.flatnonzero(start)
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    end[inner - 1] = solid[inner - 1]
    ends = np.flatnonzero(end) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * powers(len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(raw), True)[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, its end, first word of each text and the end)."""
    if len(raw) <= CHUNK:
        parts = [(0, *_hash_words(raw, offsets))] if len(raw) else []
    else:  # in chunks that end behind white space or a text, so that no word is cut
        parts, at = [], 0
        free = np.union1d(np.flatnonzero(_SPACE[raw]) + 1, offsets)
        while at < len(raw):
            k = np.searchsorted(free, at + CHUNK, side="right") - 1
            stop = int(free[k]) if k >= 0 and free[k] > at else int(free[np.searchsorted(free, at, side="right")])
            parts.append((at, *_hash_words(raw[at:stop], offsets - at)))
            at = stop
    join = lambda i, t: np.concatenate([np.zeros(0, t), *[p[i] + (t(p[0]) if i > 1 else t(0)) for p in parts]]).astype(t)
    hashes, starts, ends = join(1, np.uint64), join(2, np.int64), join(3, np.int64)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places hold nothing of use."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        out[: len(hashes) - j] += hashes[j:] * powers(k)[j] if j < len(hashes) else 0
    return mix(out)
