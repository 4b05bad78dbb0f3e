"""What the pair-finding operators share: minimizers, and the texts of a set of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BROADCAST_KEYS = 1_000_000
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours: len(x) - width + 1 values."""
    size, y = 1, x.copy()
    while 2 * size <= width:
        np.minimum(y[:-size], y[size:], out=y[:-size])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(y[:n], y[width - size : width - size + n])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, the place of its least one, by 40 bits and then the leftmost.

    It depends on the window's content alone, so equal windows have it at the same distance from their start.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes), dtype=np.uint64) & _LOW
    low = (sliding_min((hashes & ~_LOW) | place, width) & _LOW).astype(np.int64)
    start = np.arange(len(low))
    return start + ((low - start) & int(_LOW))


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs (key, text) whose key is among keys (key, distinct); keys are broadcast up to a bound."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
