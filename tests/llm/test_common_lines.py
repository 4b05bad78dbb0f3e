"""What is tried for lines that many documents share and that make no passage."""

import random

import numpy as np

from stemma.llm import passages
from stemma.llm.workspace import Workspace


def test_no_pairs_of_documents_with_one_line(spark, monkeypatch):
    """A line of 25 words in 200 documents: chains were one for each pair of them; an edited passage among them is found."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(60_000)}" for _ in range(n)]
    line, passage = say(25), say(80)
    rows = [(k, say(40) + line + say(40)) for k in range(200)]
    rows[50] = (50, say(30) + line + passage)
    rows[150] = (150, say(20) + line + [f"e{i}" if i % 20 == 10 else w for i, w in enumerate(passage)])
    chains, save = [], Workspace.save

    def counted(self, df, table):
        out = save(self, df, table)
        if table in ("more", "chains"):
            chains.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    out = passages.find_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"), "doc_id", "text").collect()
    assert sum(chains) <= 2 * len(rows)
    assert any(r.key == 150 and r.source == 50 and r.stop - r.start >= 90 for r in out)


def test_going_on_equals_brute_force():
    rng = np.random.default_rng(3)
    width, at = 2 * passages.AROUND + passages.SEED, passages.AROUND
    words = rng.integers(1, 3, (120, width)).astype(np.uint32)
    words[:, at : at + passages.SEED] = 9
    words[::7, :10] = 0
    seed, mine = np.repeat([0, 1], 60), rng.random(120) < 0.5

    def on(a, b, least):
        n = next((n for n in range(len(a)) if a[n] != b[n] or a[n] == 0), len(a))
        ok = lambda x, i: len(x) >= i + 4 and (x[i : i + 4] != 0).all()
        return n >= least and n < len(a) and any(ok(a, n + x) and ok(b, n + y) and (a[n + x : n + x + 4] == b[n + y : n + y + 4]).all() for x in range(4) for y in range(4) if a[n] and b[n])

    wanted = {(i, j) for i in range(120) for j in range(120) if mine[i] and seed[i] == seed[j] and i != j and (on(words[i, at:], words[j, at:], passages.SEED) or on(words[i, at - 1 :: -1], words[j, at - 1 :: -1], 0))}
    i, j = passages.going_on(seed, words, mine)
    assert set(zip(i.tolist(), j.tolist())) == wanted and wanted
