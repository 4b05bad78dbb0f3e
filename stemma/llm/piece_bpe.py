"""Operator 5: SentencePiece BPE encoding and decoding by vectorised merge rounds.

Encoding works on the distinct segments of a batch. Their characters lie in one flat symbol array. In each round
every word's best pair is found by a segmented minimum of pair ranks, its leftmost occurrences are merged at once
in all words, and the arrays are compacted; words without a pair drop out. Where a merged piece could take part in
a pair that ranks as high as itself, only the leftmost occurrence is merged in that round, which is what the
sequential algorithm does. Words of more than LONG_WORD characters, for which rounds would cost the square of the
length, are merged by the same rule with a heap.

Cases: null is the empty text (only the end id); repeated rows give repeated rows; characters without a piece fall
back to bytes; all other input columns are left aside, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrow_text import fill, flat, slices
from .segments import SPACE, SegmentCache, cut, distinct, piece_joins

LONG_WORD = 1000
NONE = np.iinfo(np.int32).max
SHIFT = 22  # bits of a symbol


class PieceModel:
    """A SentencePiece BPE model with byte fallback, from its serialised form."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only identity normalisation with a leading blank is built")
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback are built")
        self.eos, self.unk_surface = model.trainer_spec.eos_id, model.trainer_spec.unk_surface.encode()
        n = self.n = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        scores = {p: model.pieces[i].score for p, i in normal.items()}
        self.byte_id = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(b"" if p.type == 3 else self.unk_surface if p.type == 2 else p.piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.joins = piece_joins(list(normal))
        # Symbols: a piece's id, or n + code point for a character without a piece.
        self.of_char = n + np.arange(0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(SPACE)]
        of = lambda s: normal.get(s, n + ord(s) if len(s) == 1 else None)
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, merged, rank = [], [], []
        safe = np.ones(n, bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = of(p[:k]), of(p[k:])
                if left is not None and right is not None:
                    keys.append(left << SHIFT | right)
                    merged.append(i)
                    rank.append(levels[scores[p]])
                    for part in (p[:k], p[k:]):
                        if part in normal and scores[p] >= scores[part]:
                            safe[normal[part]] = False
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.rank = np.array(rank, np.int32)[order]
        many = np.bincount(np.array([levels[s] for s in scores.values()]))
        level_of = np.zeros(n, np.int64)
        for p, i in normal.items():
            level_of[i] = levels[scores[p]]
        self.safe = safe & (many[level_of] == 1)  # else one merge of a word at a time

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NONE where no piece is made."""
        key = left.astype(np.int64) << SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, flat; count of each word's). A word is a piece of text with its blanks, not empty."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym, word = self.of_char[chars], np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        if len(words) and lengths.max() > LONG_WORD:
            ends = np.cumsum(lengths)
            for w in np.flatnonzero(lengths > LONG_WORD):
                out = self._by_heap(sym[ends[w] - lengths[w] : ends[w]].tolist())
                done_sym.append(np.array(out, np.int32))
                done_word.append(np.full(len(out), w))
            short = lengths[word] <= LONG_WORD
            sym, word = sym[short], word[short]
        rank = np.full(len(sym), NONE, np.int32)
        into = np.zeros(len(sym), np.int32)
        stale = np.arange(max(0, len(sym) - 1))
        while len(sym):
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale], into[stale] = self.pairs(sym[stale], sym[stale + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            open_word = np.repeat(best != NONE, counts)
            if not open_word.all():  # compaction: finished words leave
                done_sym.append(sym[~open_word])
                done_word.append(word[~open_word])
                sym, word, rank, into = sym[open_word], word[open_word], rank[open_word], into[open_word]
                counts, best = counts[best != NONE], best[best != NONE]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(counts)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[1:]]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[first | (self.safe[into[hit]] & ((np.arange(len(hit)) - run) % 2 == 0))]
            sym[hit] = into[hit]
            rank[hit] = NONE
            last = np.r_[word[1:] != word[:-1], True]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            rank[hit[last[hit + 1]]] = NONE
            place = np.cumsum(keep) - 1
            at = place[hit]
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            stale = np.unique(np.r_[at, at - 1])
            stale = stale[(stale >= 0) & (stale < len(sym) - 1)]
            rank[stale] = NONE
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _by_heap(self, sym: list[int]) -> list[int]:
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        size = [1] * n
        rank, into = self.pairs(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r), i, 2, int(m)) for i, (r, m) in enumerate(zip(rank, into)) if r != NONE]
        heapq.heapify(heap)

        def look(i: int) -> None:
            j = after[i]
            if j < n:
                r, m = self.pairs(np.array([sym[i]]), np.array([sym[j]]))
                if r[0] != NONE:
                    heapq.heappush(heap, (int(r[0]), i, size[i] + size[j], int(m[0])))

        while heap:
            _, i, total, m = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != total:
                continue
            sym[i], size[i], size[j] = m, total, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                look(before[i])
            look(i)
        return [s for s, k in zip(sym, size) if k]

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[odd] - self.n).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in raw]
            starts = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            at = np.repeat(starts[odd], times[odd]) + np.concatenate([np.arange(len(b)) for b in raw])
            sym[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=n_words)

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids. Control ids are silent; bytes that form no character are replaced one by one."""
        return self._text(b"".join(self.surface[i] for i in ids))

    def _text(self, raw: bytes) -> str:
        raw = raw[1:] if raw[:1] == b" " else raw  # the leading blank that encoding puts first
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(raw):
                size = next((k for k in (1, 2, 3, 4) if _is_char(raw[i : i + k])), 0)
                out.append(raw[i : i + size].decode() if size else "�")
                i += size or 1
            return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_CODERS: dict[bytes, tuple] = {}


def coder(proto: bytes) -> tuple[PieceModel, SegmentCache, pa.Array, pa.Array]:
    """The model and what is kept with it in a worker: cache, decimal ids, surfaces."""
    key = hashlib.sha256(proto).digest()
    if key not in _CODERS:
        _CODERS.clear()
        model = PieceModel(proto)
        _CODERS[key] = (model, SegmentCache(model.encode_words), pa.array([str(i).encode() for i in range(model.n)], pa.binary()), pa.array(model.surface, pa.binary()))
    return _CODERS[key]


def encode_texts(column: pa.Array, proto: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with the end id after each, offsets): column has no nulls."""
    model, cache, _, _ = coder(proto)
    raw, offsets = flat(column)
    sizes = np.diff(offsets)
    lead = np.flatnonzero(sizes)  # the leading blank of each text that isn't empty
    padded = np.insert(raw, offsets[lead], 32)
    offsets = offsets + np.r_[0, np.cumsum(sizes > 0)]
    bounds, firsts = cut(padded, offsets, model.joins)
    words, index = distinct(padded, bounds)
    ids, ends = cache.gather(cache.look_up(words)[index], firsts) if words else (np.zeros(0, np.int32), np.zeros(len(offsets), np.int64))
    return np.insert(ids, ends[1:], model.eos), ends + np.arange(len(ends))


def encode_decode(docs: DataFrame, key: str, text: str, proto: bytes) -> DataFrame:
    """One row for each document: key, ids (array of int, with the end id), decoded (string from these ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, offsets, decoded in _coded(batches, shared.value):
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, key: str, text: str, proto: bytes) -> DataFrame:
    """One row for each document: key, n_tokens, ids_sha256, decoded_sha256; ids and texts don't leave the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, offsets, decoded in _coded(batches, shared.value):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), coder(shared.value)[2].take(pa.array(ids)))
            joined = pc.binary_join(lists, b" ")
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets)), _sha(joined.to_pylist()), _sha([d.encode() for d in decoded])], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def _sha(values: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())


def _coded(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    model, _, _, surfaces = coder(proto)
    for batch in batches:
        texts = fill(batch.column(1))
        for start, stop in slices(texts):
            ids, offsets = encode_texts(texts.slice(start, stop - start), proto)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), surfaces.take(pa.array(ids)))
            yield batch.column(0).slice(start, stop - start), ids, offsets, [model._text(raw) for raw in pc.binary_join(lists, b"").to_pylist()]
