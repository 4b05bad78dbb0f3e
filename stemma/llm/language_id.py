"""Operator 12: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; a run of characters that are no letters is one blank. The n-grams of ORDERS characters, blanks
between words included, are hashed into buckets, so a blank tells where words begin and end, and digits and signs, which
say nothing of a language, are not seen. Each task counts the buckets of its texts by language in arrays and gives out
its sums; Spark adds them up. A language's log-probabilities are those of its counts, with SMOOTHING added to each
bucket, and its prior is its share of the texts. All labelled texts are counted; no sample is drawn.

The matrix of log-probabilities (buckets x languages) is broadcast. It has at most CELLS cells, whatever the data: the
more languages, the fewer buckets. A batch is scored as flat arrays: one gather from the matrix for each language and
order, summed up by text. The score is the prediction's posterior probability.

Cases: null texts and texts without a letter are UNKNOWN with score 0; so is every text if nothing could be learnt (no
labelled text); rows with a null language or a null key are not learnt from; repeated rows are counted and predicted each;
of languages with equal probability the first in the order of their names is taken; more than CELLS >> LEAST_BITS
languages are an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import fill, lean, slices

ORDERS = (1, 2, 3)
SLICE_BYTES = 1 << 17  # arrays of a slice then stay in the cache
CELLS, MOST_BITS, LEAST_BITS = 1 << 22, 16, 8
SMOOTHING = 0.5
AT_ONCE = 8  # languages whose log-probabilities are gathered together
UNKNOWN = "und"
_BLANK = 32
_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters of any script."""
    if not _letters:  # once in each worker
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (number of the text, bucket) of every n-gram; texts without letters have none."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = is_letter(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # the first of a run of other characters, and the first of a text
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    letter, owner = letter[at], owner[at]
    symbols = np.where(letter, points[at], np.uint32(_BLANK))
    hashes, seen = np.zeros(len(symbols), np.uint32), np.zeros(len(symbols), bool)
    for n in range(1, max(ORDERS) + 1):
        size = len(symbols) - n + 1
        if size <= 0:
            break
        hashes = (hashes[:size] ^ (hashes[:size] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + symbols[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        seen = seen[:size] | letter[n - 1 :]
        if n in ORDERS:
            inside = np.flatnonzero(seen & (owner[:size] == owner[n - 1 :]))
            spread = hashes[inside]
            spread = (spread ^ (spread >> np.uint32(16))) * np.uint32(0xC2B2AE35)
            yield owner[inside], (spread >> np.uint32(32 - bits)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    texts = fill(column)
    for start, stop in slices(texts, SLICE_BYTES):
        yield start, stop, texts.slice(start, stop - start).to_pylist()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray  # buckets x languages

    @property
    def bits(self) -> int:
        return int(self.log_probability.shape[0]).bit_length() - 1


def _bits(n_languages: int) -> int:
    bits = min(MOST_BITS, (CELLS // max(1, n_languages)).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{n_languages} languages are more than {CELLS >> LEAST_BITS}")
    return bits


def train(docs: DataFrame, text: str, lang: str, use: Column) -> Model:
    """A model of the languages of the rows for which `use` holds."""
    rows = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    most = CELLS >> LEAST_BITS
    prior = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    names = sorted(prior)
    bits = _bits(len(names))
    place = {name: i for i, name in enumerate(names)}

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 1 << bits), np.int64)
        for batch in batches:
            which = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for start, _, texts in _texts(batch.column(1)):
                for owner, bucket in grams(texts, bits):
                    np.add.at(sums.reshape(-1), (which[start + owner] << bits) + bucket, 1)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.reshape(-1)[cell])], ["cell", "n"])

    counted = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    sums = np.zeros(len(names) << bits)
    sums[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    smooth = sums.reshape(len(names), 1 << bits) + SMOOTHING
    n = np.array([prior[x] for x in names], float)
    return Model(names, np.log(n / max(1.0, n.sum())), np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T))


def posteriors(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the text has a letter, place of the likeliest language, its posterior) of each text."""
    total = np.tile(model.log_prior[:, None], (1, len(texts)))
    known = np.zeros(len(texts), bool)
    for owner, bucket in grams(texts, model.bits):
        if not len(owner):
            continue
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        known[owner[starts]] = True
        for i in range(0, len(total), AT_ONCE):
            total[i : i + AT_ONCE, owner[starts]] += np.add.reduceat(np.take(model.log_probability[:, i : i + AT_ONCE], bucket, axis=0), starts, axis=0).T
    best = total.argmax(axis=0) if len(total) else np.zeros(len(texts), int)
    top = total.max(axis=0) if len(total) else np.zeros(len(texts))
    return known, best, 1 / np.maximum(1.0, np.exp(total - top).sum(axis=0))


def predict(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for start, stop, texts in _texts(batch.column(1)):
                known, best, score = posteriors(model, texts)
                known &= bool(model.languages)
                said = names[np.where(known, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))], ["key", "lang_pred", "score"])

    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
