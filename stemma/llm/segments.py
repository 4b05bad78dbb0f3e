"""Cutting texts where no token can cross, so that each distinct segment is encoded once.

A cut between two characters is exact if the tokenizer can never build a token that holds both. For a piece
model those are the character pairs that occur in no piece of the vocabulary; for byte-level BPE with the usual
pre-tokeniser they follow from its pattern. The tokens of a text are then those of its segments in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = "▁"
_AFTER_LETTER = np.array([b in (9, 10, 32) or (33 <= b < 127 and not chr(b).isalnum() and chr(b) != "'") for b in range(256)])
CACHE_SEGMENTS = 1_000_000


def piece_joins(pieces: list[str]) -> np.ndarray:
    """joins[a, b]: some piece holds neighbouring characters of which the first ends in byte a, the second begins with b."""
    joins = np.zeros((256, 256), bool)
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    for left, right in pairs:
        lasts = [left.encode()[-1]] + ([32] if left == SPACE else [])
        firsts = [right.encode()[0]] + ([32] if right == SPACE else [])
        for a in lasts:
            for b in firsts:
                joins[a, b] = True
    joins[:, 128:192] = True  # inside a character
    return joins


def byte_level_joins() -> np.ndarray:
    """Pairs that the byte-level pre-tokeniser may keep together; every other pair is a boundary in any context.

    Its tokens are contractions, an optional blank with letters, with digits or with other marks, and white space.
    So a boundary is sure between a mark or letter and an ASCII blank after it, and between an ASCII letter and an
    ASCII mark other than the apostrophe. A run of white space looks at the character after it, so a cut behind it
    is exact only if the run is one line feed: that needs three characters and is left to cut().
    """
    joins = np.ones((256, 256), bool)
    solid = np.array([33 <= b < 127 for b in range(256)])
    letter = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
    mark = solid & ~letter & np.array([not chr(b).isdigit() and chr(b) != "'" for b in range(256)])
    for blank in (9, 10, 32):
        joins[solid, blank] = False
    joins[np.ix_(letter, mark)] = False
    return joins


def cut(raw: np.ndarray, offsets: np.ndarray, joins: np.ndarray, byte_level: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(segment offsets in raw, first segment of each text): texts are cut at every pair that can't join.

    byte_level: also where byte-level BPE needs more than two bytes to be sure: behind a line feed between two
    printable ASCII characters, and before an ASCII blank or mark behind a Latin letter of two bytes.
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    start = np.zeros(len(raw) + 1, bool)
    np.logical_not(joins.ravel()[(raw[:-1].astype(np.uint16) << 8) | raw[1:]], out=start[1:-1])
    if byte_level:
        solid = (raw > 32) & (raw < 127)
        start[2:-1] |= (raw[1:-1] == 10) & solid[:-2] & solid[2:]
        latin = (raw[:-2] >= 0xC3) & (raw[:-2] <= 0xC9) & ((raw[:-2] != 0xC3) | ((raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)))
        start[2:-1] |= latin & _AFTER_LETTER[raw[2:]]
    start[offsets] = True
    start[-1] = True
    bounds = np.flatnonzero(start)
    return bounds, np.searchsorted(bounds, offsets)


def distinct(raw: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(distinct segments, for each segment its place among them)."""
    if len(bounds) < 2:
        return [], np.zeros(0, np.int64)
    array = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = array.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


class SegmentCache:
    """Ids of segments, flat; forgets everything when it holds more than CACHE_SEGMENTS of them."""

    def __init__(self, encode):
        self.encode, self.place = encode, {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, segments: list[str]) -> np.ndarray:
        """The place of each segment; places stay valid until the next call."""
        if len(self.place) > CACHE_SEGMENTS:
            self.place, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        place = self.place
        new = [s for s in segments if s not in place]
        if new:
            ids, lengths = self.encode(new)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            place.update(zip(new, range(len(place), len(place) + len(new))))
        return np.fromiter(map(place.__getitem__, segments), np.int64, len(segments))

    def gather(self, places: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments at these places in order, offset of each text's ids)."""
        starts = self.ends[places]
        lengths = self.ends[places + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[at], ends[firsts]
