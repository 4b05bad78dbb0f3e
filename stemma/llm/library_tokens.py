"""Ids from the tokenizers and sentencepiece libraries, each distinct segment encoded once in a worker."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .arrow_text import flat
from .segments import SegmentCache, byte_level_joins, cut, distinct, piece_joins

GUARD = "\n"
JOINED = 2000  # segments that go to the library in one string, parted by GUARD
_SOLID = re.compile(r" ?\S+").fullmatch
_SINGLE = regex.compile(r" ?\p{L}+| ?[!-&(-/:-@\[-`{-~]+").fullmatch  # one pre-token of byte-level BPE


class LibraryTokenizer:
    """ids(texts) as the library gives them for whole texts, without begin, end or added special tokens.

    kind is "json" (tokenizers) or "model" (sentencepiece). A text that holds the string of a special token, and
    every text under a tokenizer for which no exact cut is known, goes to the library whole.
    """

    def __init__(self, kind: str, blob: bytes):
        self.special: list[str] = []
        self.cuts = False
        if kind == "model":
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2 as pb

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
            model = pb.ModelProto()
            model.ParseFromString(blob)
            norm = model.normalizer_spec
            self.joins = piece_joins([p.piece for p in model.pieces if p.type in (1, 4, 5)])
            self.special = [p.piece for p in model.pieces if p.type == 4]
            self.cuts = not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or self.joins[10, :128].any() or self.joins[10, 192:].any() or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix)
            self.lone, self.prefix, self.bare = False, norm.add_dummy_prefix, None
            self.whole = lambda texts: self.sp.encode(texts, num_threads=1)
        elif kind == "json":
            from tokenizers import Tokenizer

            hf = Tokenizer.from_str(blob.decode())
            hf.no_truncation()
            hf.no_padding()
            spec = json.loads(blob)
            pre = spec.get("pre_tokenizer") or {}
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE"
            self.joins, self.lone, self.prefix = byte_level_joins(), True, False
            self.whole = lambda texts: [e.ids for e in hf.encode_batch_fast(texts, add_special_tokens=False)]
            if self.cuts:
                self.bare = Tokenizer(hf.model)  # takes pre-tokens in the alphabet of bytes
                self.letters = {b: c for b, c in enumerate(_byte_alphabet())}
        else:
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.cache = SegmentCache(self._encode)
        if self.cuts:
            self.lead = self.whole([GUARD])[0]
            self.cuts = len(self.lead) <= 2
            self.guard = self.lead[-1]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A library call costs far more than a word, so words go together.

        Single pre-tokens of byte-level BPE go to its BPE model as a list. Other solid words go in one string, parted
        by line feeds: a line feed is a token of its own beside printable characters and no token of such a word, so
        its id parts the ids of the words. What is left goes each in a call of its own, behind a line feed if the
        library puts a blank before each text.
        """
        ids: list[np.ndarray] = [None] * len(words)
        others = range(len(words))
        if self.bare:
            single = np.fromiter((_SINGLE(w) is not None for w in words), bool, len(words))
            self._singles(words, np.flatnonzero(single).tolist(), ids)
            others = np.flatnonzero(~single).tolist()
        good, rest = [], []
        for i in others:
            (good if _SOLID(words[i]) else rest).append(i)
        groups = [good[i : i + JOINED] for i in range(0, len(good), JOINED)]
        for group, got in zip(groups, self.whole([GUARD + GUARD.join(words[i] for i in g) for g in groups])):
            flat_ids = np.array(got[len(self.lead) - 1 :], np.int32)
            ends = np.r_[np.flatnonzero(flat_ids == self.guard), len(flat_ids)]
            for i, a, b in zip(group, (ends[:-1] + 1).tolist(), ends[1:].tolist()):
                ids[i] = flat_ids[a:b]
        head = len(self.lead) if self.prefix else 0
        for i, got in zip(rest, self.whole([GUARD * self.prefix + words[i] for i in rest])):
            ids[i] = np.array(got[head:], np.int32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([np.zeros(0, np.int32), *ids]), lengths

    def _spelt(self, word: str) -> str:
        if word.isascii():  # of letters or marks behind a blank, which alone has another character
            return self.letters[32] + word[1:] if word[0] == " " else word
        return word.encode().decode("latin-1").translate(self.letters)

    def _singles(self, words: list[str], which: list[int], ids: list) -> None:
        groups = [which[i : i + JOINED] for i in range(0, len(which), JOINED)]
        spelt = [[self._spelt(words[i]) for i in g] for g in groups]
        for group, got in zip(groups, self.bare.encode_batch(spelt, is_pretokenized=True, add_special_tokens=False)):
            flat_ids = np.array(got.ids, np.int32)
            ends = np.r_[0, np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(group)))].tolist()
            for i, a, b in zip(group, ends, ends[1:]):
                ids[i] = flat_ids[a:b]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, flat; offsets). column has no nulls."""
        odd = np.full(len(column), not self.cuts)
        for token in self.special if self.cuts else ():
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if odd.all():
            return self._whole(column)
        if not odd.any():
            return self._cut(column)
        plain = np.flatnonzero(~odd)
        a, ends_a = self._cut(column.take(pa.array(plain)))
        b, ends_b = self._whole(column.take(pa.array(np.flatnonzero(odd))))
        lengths = np.zeros(len(column), np.int64)
        lengths[~odd], lengths[odd] = np.diff(ends_a), np.diff(ends_b)
        out = np.zeros(len(a) + len(b), np.int32)
        from_odd = np.repeat(odd, lengths)
        out[~from_odd], out[from_odd] = a, b
        return out, np.r_[0, np.cumsum(lengths)]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(column.to_pylist())
        ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])), ends

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = flat(column)
        if self.prefix:
            some = np.diff(offsets) > 0
            raw = np.insert(raw, offsets[:-1][some], 32)
            offsets = offsets + np.r_[0, np.cumsum(some)]
        bounds, firsts = cut(raw, offsets, self.joins, self.lone)
        words, index = distinct(raw, bounds)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        return self.cache.gather(self.cache.look_up(words)[index], firsts)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE: itself, or the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_MADE: dict[bytes, LibraryTokenizer] = {}


def made(kind: str, blob: bytes) -> LibraryTokenizer:
    """The worker's tokenizer for this file; a worker keeps one."""
    key = hashlib.sha256(blob).digest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = LibraryTokenizer(kind, blob)
    return _MADE[key]


def read(path: str) -> tuple[str, bytes]:
    """(kind, content) of a tokenizer file on the driver; it is sent to executors, so its size is checked."""
    with open(path, "rb") as f:
        blob = f.read()
    if len(blob) > 64 << 20:
        raise ValueError(f"{path} is larger than a tokenizer file may be (64 MB)")
    return path.rpartition(".")[2], blob
