"""Operator 1: a quality classifier from pairwise preferences (Bradley-Terry).

A good labelled text is preferred to a bad one. The strength of a text is linear in its features: sizes, shares of kinds
of characters and of repetition, and the shares of its words and byte trigrams in hashed buckets. The weights are those
that maximise the likelihood of the preferences, which is logistic loss on feature differences, with a ridge. The cut is
the quantile of training strengths that leaves the share of bad training texts below it; scores are the logistic of the
strength's distance to the cut, shifted so that the cut has the score CUT_SCORE.

Training takes at most SAMPLE labelled texts (the ones with the smallest hash of their key) and PAIRS preferences
drawn from them; that is the bound of what reaches the driver. A preference's loss depends on the two strengths alone,
so its gradient is summed up by text and no matrix of differences is made. Every text is scored, over its whole length.

Cases: null and empty texts have the features of no words; repeated rows are scored each; labels that are null or
lack a text are left aside, of several for a key the highest counts; without both kinds of label all scores are 0.5;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import fill, flat, lean, slices
from .words import word_hashes

SAMPLE = 20_000
PAIRS = 60_000
CUT_SCORE = 0.3
RIDGE = 1e-3
BUCKETS = 256  # of words, and again of byte trigrams
STEPS, RATE = 240, 0.03
N_SHARES = 9
N_DENSE = 3 + 2 * N_SHARES
N_FEATURES = N_DENSE + 2 * BUCKETS


def _dense(text: str) -> np.ndarray:
    """Sizes, shares of kinds of characters, and repetition: all from the text alone."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = set(zip(words, words[1:]))
    shares = np.array([
        raw[65:91].sum() / size,
        raw[[35, 36, 37, 38, 42]].sum() / size,
        raw[124] / n,
        raw[33] / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(pairs) / max(1, len(words) - 1),
        raw[48:58].sum() / size,
        sum(map(str.__eq__, words, words[1:])) / n,
    ])
    shares = np.clip(shares, 0, 1)
    return np.concatenate([[np.log1p(len(words)), min(1.0, len(words) / 50), size / n if words else 0.0], shares, np.sqrt(shares)])


def _shares(owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """The square root of each bucket's share in each of n texts."""
    counts = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES for each text."""
    raw, offsets = flat(texts)
    n = len(texts)
    hashes, _, _, firsts = word_hashes(raw, offsets)
    words = _shares(np.repeat(np.arange(n), np.diff(firsts)), (hashes >> np.uint64(56)).astype(np.int64), n)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    x = raw.astype(np.uint32)
    codes = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
    codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x9E3779B1)
    inside = np.flatnonzero(owner[: len(codes)] == owner[2:]) if len(x) > 2 else np.zeros(0, np.int64)
    trigrams = _shares(owner[inside], (codes[inside] >> np.uint32(24)).astype(np.int64), n)
    dense = np.array([_dense(t) for t in texts.to_pylist()], float).reshape(n, N_DENSE)
    return np.concatenate([dense, words, trigrams], axis=1).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights on standardised features, and the cut."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "weights": np.zeros(N_FEATURES), "shift": np.zeros(1)}
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6
    z = np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -5, 5)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w = first = second = np.zeros(N_FEATURES)
    for step in range(1, STEPS + 1):  # Adam on the loss of all preferences
        s = (z @ w.astype(np.float32)).astype(float)
        wrong = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        pull = (np.bincount(better, wrong, len(s)) - np.bincount(worse, wrong, len(s))) / PAIRS
        grad = (pull.astype(np.float32) @ z).astype(float) - RIDGE * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    strengths = np.sort(z @ w)
    k = len(bad)
    cut = (strengths[k - 1] + strengths[k]) / 2
    return {"mean": mean, "scale": scale, "weights": w, "shift": np.array([np.log(CUT_SCORE / (1 - CUT_SCORE)) - cut])}


def strength_to_score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    s = np.clip((x - model["mean"]) / model["scale"], -5, 5) @ model["weights"] + model["shift"][0]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = fill(column)
    for start, stop in slices(texts):
        yield start, stop, features(texts.slice(start, stop - start))


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, use: Column) -> dict[str, np.ndarray]:
    """labels: key and label (0 or 1); use: which of its rows may be learnt from."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & use).groupBy(F.col(key).alias("l_key")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("l_key"), "l_key").limit(SAMPLE)
    both = docs.select(F.col(key).alias("d_key"), F.col(text).alias("text")).join(F.broadcast(known), F.col("d_key") == F.col("l_key")).select("y", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, x in _slices(batch.column(1)):
                rows = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), rows], ["y", "x"])

    rows = both.mapInArrow(run, "y int, x binary").toArrow()
    y = rows["y"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T[:N_DENSE][::-1], y))  # the fit doesn't depend on the order in which rows come
    return fit(x[order], y[order])


def score(docs: DataFrame, key: str, text: str, model: dict[str, np.ndarray]) -> DataFrame:
    """key, score of every text."""
    learnt = bool(model["weights"].any())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, x in _slices(batch.column(1)):
                values = strength_to_score(model, x) if learnt else np.full(stop - start, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(values)], ["key", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, score double").withColumnRenamed("key", key)
