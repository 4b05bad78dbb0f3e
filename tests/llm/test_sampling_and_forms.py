"""Importance resampling, language identification and fill-in-the-middle against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import fill_in_middle, importance, language_id, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Resampling.


def features(text, most):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, most=1, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank, n_words) of docs, a list of (doc_id, text)."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    every = [(i, *features(t, most)) for i, t in docs]
    s = collections.Counter(bucket(x) for _, _, f in every for x in f)
    t = collections.Counter(bucket(x) for text in target for x in features(text, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in every:
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        w = sum(gain[bucket(x)] for x in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100], start=1):
        r[4] = k
    return sorted(map(repr, map(tuple, rows)))


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_importance_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(queries.QUERIES["op11_importance"](spark, SF)) == resampled(docs, target)


def test_importance_of_odd_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "x" * 33, "y" * 500, "é", "日本", "12", "a"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, say(rng.randrange(40))) for i in range(200)] + [(None, None), (None, say(30)), (7, None), (8, ""), (9, ". , \n"), (-5, say(25)), (1 << 62, say(25)), (-(1 << 62), say(25))]
    docs += [(500, docs[3][1])] * 5 + [(501, say(21))] * 40  # repeated rows: ties in score and key
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, weight string, score int")
    target = spark.createDataFrame([("alpha beta 12",), (None,), ("",)], "text string")
    for most, percent in ((1, 10), (3, 50), (2, 100), (1, 0)):
        out = importance.resample(frame, "doc_id", "text", target, "text", max_words=most, percent=percent)
        assert got(out) == resampled(docs, ["alpha beta 12"], most, percent)
    empty = frame.limit(0)
    assert importance.resample(empty, "doc_id", "text", target, "text").count() == 0
    assert importance.resample(frame, "doc_id", "text", target.limit(0), "text").count() == len(docs)


def test_radix_selection_finds_every_prefix(spark):
    rng = np.random.default_rng(4)
    values = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 300) * (1 << 40), rng.permutation(300))]
    frame = spark.createDataFrame(values, "a long, b long")
    order = [F.col("a"), F.col("b")]
    for k in (0, 1, 50, 149, 299, 300, 301):
        kept = frame.where(importance.least(frame, order, k)).collect()
        assert sorted(map(tuple, kept)) == sorted(values)[:k]


# Languages.


def test_languages_of_the_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op12_language_id"](spark, sf).collect()
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_language_counts_and_posteriors(spark):
    """The model's sums and the posteriors by plain loops over n-grams as strings, whose buckets are taken from the operator."""
    texts = [(1, "Der Hund, die Katze!", "de"), (2, "the dog 12 and the cat", "en"), (3, "den   hunden", "de"), (4, "日本 x", "ja"), (5, None, "en"), (6, "12 !?", "en"), (7, "ünd", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.train(frame, "text", "lang", F.lit(True))
    plain = lambda t: re.sub(r"[^a-zäöüß日本]+", " ", t.lower())
    grams = lambda s: [s[i : i + n] for n in language_id.ORDERS for i in range(len(s) - n + 1) if s[i : i + n].strip()]
    number = lambda g: next(int(b[-1]) for n, (_, b) in zip(language_id.ORDERS, language_id.grams([g], model.bits)) if n == len(g))
    assert model.languages == ["de", "en", "ja"]
    counts = {lang: collections.Counter() for lang in model.languages}
    for _, t, lang in texts:
        if t and lang:
            counts[lang].update(number(g) for g in grams(plain(t)))
    size = 1 << model.bits
    log = lambda lang, b: math.log((counts[lang][b] + language_id.SMOOTHING) / (sum(counts[lang].values()) + language_id.SMOOTHING * size))
    prior = {"de": 2 / 5, "en": 2 / 5, "ja": 1 / 5}  # null texts are no texts
    out = {r.doc_id: r for r in language_id.predict(frame, "doc_id", "text", model).collect()}
    for i, t, _ in texts:
        if not t or not re.search("[a-zäöü日本]", t.lower()):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        total = {lang: math.log(prior[lang]) + sum(log(lang, number(g)) for g in grams(plain(t))) for lang in prior}
        best = max(total, key=total.get)
        assert out[i].lang_pred == best
        assert out[i].score == pytest.approx(1 / sum(math.exp(x - total[best]) for x in total.values()))


def test_languages_without_labels_and_of_many(spark):
    frame = spark.createDataFrame([(1, "text", None), (2, None, "en"), (None, "ä", None)], "doc_id long, text string, lang string")
    model = language_id.train(frame, "text", "lang", F.lit(True))
    assert {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(frame, "doc_id", "text", model).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)}
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}" * 5, f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    model = language_id.train(many, "text", "lang", F.lit(True))
    assert model.bits < language_id.MOST_BITS and model.log_probability.size <= language_id.CELLS
    assert np.mean([r.lang_pred == f"l{r.doc_id}" for r in language_id.predict(many, "doc_id", "text", model).collect()]) > 0.95


# Fill-in-the-middle.


def filled(i, text, units, form_of=None):
    """(n, form, prefix, middle, output) by slices of a list of units."""
    n = len(units)
    h = sha(f"1:{'' if i is None else i}")
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op13_fill_in_middle"](spark, SF).collect()
    assert len(out) == len(texts) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        n, form, p, m, output = filled(r.doc_id, texts[r.doc_id], texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p if p is None else len(p), m if m is None else len(m), sha(output), sha(texts[r.doc_id]))


#: What each grammar's units are, as Python patterns.
UNITS = {
    "characters": r"[\s\S]", "bytes of ASCII, runs beyond": r"[\x00-\x7F]|[^\x00-\x7F]+", "words and blanks": r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+",
    "lines": r"\n|[^\n]+", "words, blanks, signs": r"[ \t\n\x0b\f\r]+|[0-9A-Za-z_éü日本́]+|[.,!<>]|[😀]",
}


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_fill_in_middle_of_each_grammar(spark, block, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)  # the driver's side alone: where blocks end
    monkeypatch.setattr(fill_in_middle, "BLOCKS", 1 << 20)
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice(["a", "B", "é", "日", "😀", " ", "\n", ".", "<", "́", "\r\n", "12"]) for _ in range(n))
    rows = [(i, say(rng.randrange(1, 60))) for i in range(120)] + [(None, None), (None, "ab"), (3, ""), (4, "has <P> inside"), (5, "\n"), (6, "\x00a"), (7, "😀"), (7, "😀😀")]
    frame = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, form string")
    for grammar, pattern in UNITS.items():
        made = fill_in_middle.transform(frame, "doc_id", "text", grammar=grammar)
        back = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        want = [(i, *filled(i, t or "", re.findall(pattern, t or ""))) for i, t in rows if grammar != "words, blanks, signs" or "\x00" not in (t or "")]
        have = [(r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in back if grammar != "words, blanks, signs" or "\x00" not in r.text]
        assert sorted(map(repr, have)) == sorted(map(repr, want)), grammar
        assert all(r.back == r.text for r in back)
    assert fill_in_middle.transform(frame.limit(0), "doc_id", "text").count() == 0


def test_fill_in_middle_of_a_long_text_and_bad_markers(spark):
    long = "ab\n😀" * 300_000
    frame = spark.createDataFrame([(i, long) for i in (1, 2)], "doc_id long, text string")
    for r in fill_in_middle.digests(frame, "doc_id", "text").collect():
        n, form, p, m, output = filled(r.doc_id, long, long)
        assert tuple(r)[1:] == (n, form, p if p is None else len(p), m if m is None else len(m), sha(output), sha(long))
    for markers in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "x", "y"), ("<a>", "x<a>y", "z")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(frame, "doc_id", "text", markers=markers)
