"""Recall of edited passages: what a run of equal words alone doesn't find."""

import random

import pytest

from stemma.llm import passages

CASES = [(step, bits) for step in (20, 14) for bits in ("none", "before", "between")]


@pytest.fixture(scope="module")
def found(spark):
    """case -> passages of which at least 60 of 80 words are found; all cases in one table, each in words of its own."""
    rows, planted = [], []
    for c, (step, bits) in enumerate(CASES):
        rng = random.Random(c)
        say = lambda n: [f"c{c}w{rng.randrange(30_000)}" for _ in range(n)]
        for k in range(100):
            passage, at = say(80), 1_000_000 * c + 1_000 * k
            edited = [f"c{c}e{k}n{i}" if i % step == step // 2 else w for i, w in enumerate(passage)]
            rows += [(at + 100, say(40) + passage + say(40)), (at + 500, say(60) + edited + say(30))]
            planted.append((c, at + 500))
            if bits != "none":
                start = 0 if bits == "before" else 200
                rows += [(at + start + i, say(30) + passage[x : x + 15] + say(30)) for i, x in enumerate(range(0, 80, 8))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    spans = {}
    for r in passages.find_passages(docs, "doc_id", "text").collect():
        spans.setdefault(r.key, []).append((max(r.start, 60), min(r.stop, 140)))
    return {c: sum(any(b - a >= 60 for a, b in spans.get(key, [])) for case, key in planted if case == n) for n, c in enumerate(CASES)}


@pytest.mark.parametrize("case", CASES)
def test_edited_passages(found, case):
    assert found[case] >= 90
