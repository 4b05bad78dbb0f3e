"""Passages whose source is neither the first nor the last earlier document that holds their bits."""

import random

from stemma.llm import passages


def test_edited_passages_whatever_else_holds_their_bits(spark):
    """Every edited passage that is found beside its source alone is also found with bits of it in documents before and between."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(60_000)}" for _ in range(n)]
    pairs, bits = [], []
    for k in range(0, 100_000, 1_000):
        passage = say(80)
        edited = [f"e{k}n{i}" if i % 14 == 7 else w for i, w in enumerate(passage)]
        pairs += [(k + 100, say(40) + passage + say(40)), (k + 500, say(60) + edited + say(30))]
        bits += [(k + start + i, say(30) + passage[x : x + 15] + say(30)) for start in (0, 200, 300) for i, x in enumerate(range(0, 80, 6))]

    def found(rows):
        spans = passages.find_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"), "doc_id", "text")
        return {r.key for r in spans.collect() if min(r.stop, 140) - max(r.start, 60) >= 60}

    alone = found(pairs)
    assert len(alone) >= 90
    assert alone <= found(pairs + bits)


def test_passages_that_come_again_in_their_document(spark):
    """An edited passage that a document repeats is found at each of its places."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(60_000)}" for _ in range(n)]
    passage = say(80)
    edited = [f"e{i}" if i % 20 == 10 else w for i, w in enumerate(passage)]
    rows = [(start + i, say(30) + passage[x : x + 15] + say(30)) for start in (0, 200) for i, x in enumerate(range(0, 80, 6))]
    rows += [(100, say(40) + passage + say(40)), (500, say(20) + edited + say(100) + edited + say(100) + edited + say(20))]
    out = passages.find_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"), "doc_id", "text").collect()
    for at in (20, 200, 380):
        assert any(r.key == 500 and min(r.stop, at + 80) - max(r.start, at) >= 60 for r in out)
