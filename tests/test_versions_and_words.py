"""Diffs, split logs, segmentation and spellings against brute force."""

import itertools
import random
import re
import resource

import pytest
from hypothesis import given, settings, strategies as st

from stemma.operators import expand, lattice, versions as V


def full_matrix(old, new):
    """The same alignment by a table of all pairs of places."""
    a, b = V.units(old), V.units(new)
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or n[i + 1][j] >= n[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out


def before(html):
    return re.sub("</?del>", "", re.sub("(?s)<ins>.*?</ins>", "", html))


def after(html):
    return re.sub("</?ins>", "", re.sub("(?s)<del>.*?</del>", "", html))


TEXT = st.text(alphabet=st.sampled_from(list("ab,。 [c]é漢\n1")), max_size=40)


@given(TEXT, TEXT)
@settings(deadline=None, max_examples=400)
def test_diff_is_that_of_the_full_matrix(old, new):
    assert V.operations(old, new) == full_matrix(old, new)
    punctuation, text = V.split_log(old, new)
    assert before(punctuation) == old and after(punctuation) == before(text) and after(text) == new


def test_diff_of_long_texts_in_little_memory():
    rng = random.Random(1)
    say = lambda n: [chr(0x4E00 + rng.randrange(3000)) for _ in range(n)]
    old = say(100_000)
    new = list(old)
    for k in rng.sample(range(len(new)), 3000):
        new[k] = rng.choice(["", "新", new[k] * 2])
    used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ops = V.operations("".join(old), "".join(new))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - used < 1 << 20  # of kilobytes
    assert "".join(x for k, x in ops if k != "ins") == "".join(old) and "".join(x for k, x in ops if k != "del") == "".join(new)
    assert sum(k == "" for k, _ in ops) >= 97_000
    few = "".join(say(700)), "".join(say(900))  # more rows than one block
    assert V.operations(*few) == full_matrix(*few)


def test_change_logs(spark):
    old = spark.createDataFrame([(1, "如是，我聞"), (2, "same"), (3, "a b"), (4, None), (5, "x.")], "k int, t string")
    new = spark.createDataFrame([(1, "如是我聞。"), (2, "same"), (3, "a, c"), (4, "新"), (6, "y")], "k int, t string")
    rows = {(r.k, r.log): r.html for r in V.change_logs(old, new, "k", "t").collect()}
    assert rows == {
        (1, "punctuation"): "如是<del>，</del>我聞<ins>。</ins>", (3, "punctuation"): "a<ins>,</ins> b", (3, "text"): "a, <del>b</del><ins>c</ins>", (4, "text"): "<ins>新</ins>",
    }
    logs = spark.createDataFrame([(h,) for h in rows.values()], "h string").select(V.state("h", "before").alias("b"), V.state("h", "after").alias("a")).collect()
    assert [(r.b, r.a) for r in logs] == [(before(h), after(h)) for h in rows.values()]


# Segmentation.


def all_paths(text, weights, longest, unknown):
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(text) - 1)):
        words, start = [], 0
        for i, c in enumerate(cuts, start=1):
            if c:
                words.append(text[start:i])
                start = i
        words.append(text[start:])
        if any(w not in weights and len(w) > 1 for w in words) or any(len(w) > longest for w in words):
            continue
        value = (sum(weights.get(w, unknown) for w in words), -len(words), [len(w) for w in words])
        if best is None or value > best[0]:
            best = (value, words)
    return best[1]


@given(st.text(alphabet="abcd", min_size=1, max_size=10), st.dictionaries(st.text(alphabet="abcd", min_size=1, max_size=4), st.integers(-4, -1), max_size=12))
@settings(deadline=None, max_examples=300)
def test_best_path_of_all_paths(text, weights):
    longest = max(map(len, weights), default=1)
    assert lattice.best_path(text, weights, longest, -5) == all_paths(text, weights, longest, -5)


SAMPLE = ["研究/生命/起源", "研究/生命", "研究生/來/了", "生命/很/好"]


def test_best_path_differs_from_the_longest_match(spark):
    weights = lattice.word_weights(spark.createDataFrame([(s,) for s in SAMPLE], "s string"), "s")
    known = {r.word: r.weight for r in weights.collect()}
    assert expand.longest_match(frozenset(known), "研究生命起源", 3) == ["研究生", "命", "起源"]
    docs = spark.createDataFrame([(1, "研究生命起源。研究生來了，abc12"), (2, None), (3, ""), (4, "，。")], "k int, t string")
    want = {1: "研究/生命/起源/研究生/來/了/abc/12", 2: None, 3: "", 4: ""}
    assert {r.k: r.segmented for r in lattice.segment(docs, docs["t"], weights, "k").collect()} == want


def test_a_large_dictionary_is_joined(spark, monkeypatch):
    weights = lattice.word_weights(spark.createDataFrame([(s,) for s in SAMPLE], "s string"), "s", {"more": spark.createDataFrame([("起源好",), ("好了",)], "w string")}, {"more": 2.0})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["研究生命起源好了", "好了生命", None, "", "無"])], "k int, t string")
    few = [tuple(r) for r in lattice.segment(docs, docs["t"], weights, "k").orderBy("k").collect()]
    monkeypatch.setattr(lattice, "MOST_WORDS", 0)
    assert [tuple(r) for r in lattice.segment(docs, docs["t"], weights, "k").orderBy("k").collect()] == few
    assert few[0][2] == "研究/生命/起源好/了" or few[0][2] == "研究/生命/起源/好了"


# Spellings.


def test_spellings_of_a_table(spark):
    words = spark.createDataFrame([("abca",), ("x",), (None,), ("",), ("abca",)], "w string")
    variants = spark.createDataFrame([("a", "é,à"), ("c", "k"), ("a", "é"), ("z", "s"), ("b", "")], "k string, vars string")
    forms = {"a": "aéà", "c": "ck"}
    want = {(w, "".join(p)) for w in ("abca", "x", "") for p in itertools.product(*[forms.get(c, c) for c in w])}
    assert {tuple(r) for r in expand.spellings(words, "w", variants).collect()} == want


@pytest.mark.parametrize("query, spellings", [("ab", {"ab", "éb"}), ("x", {"x"})])
def test_expansions_of_a_query(spark, query, spellings):
    assert {r.spelling for r in expand.expansions(spark, query, {"a": "é"}).collect()} == spellings
