"""What the stored index takes: bytes of disk for its postings, and what is shuffled to make them."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import endpoints as E, kwic, phrase_index as P, search as S

rng = random.Random(3)
WORDS = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
ROWS = [(i, rng.choice("TX"), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 900)))) for i in range(400)] + [(900, "T", ""), (901, "T", None), (902, "X", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "n long, canon string, content string")


def bytes_of(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_postings_take_the_size_of_the_texts(spark, docs, tmp_path):
    before = shuffle_files(spark)
    P.build(docs, f"file://{tmp_path}/i", "n", ["content"], "canon", buckets=4)
    assert bytes_of(f"{tmp_path}/i/postings") < 1.5 * sum(len(r[2] or "") for r in ROWS)
    assert not [f for f in shuffle_files(spark) - before if f.endswith(".data")]  # dropped with the writes


@pytest.mark.parametrize("most", [1 << 12, 1 << 30])
def test_rounds_and_slices_say_the_same(spark, docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(P, "ROUND", most)  # the postings are made in eight rounds, or in one
    monkeypatch.setattr(P, "SLICE", most)
    index = P.build(docs, f"file://{tmp_path}/i", "n", ["content"], "canon", buckets=4)
    filled = docs.fillna("", ["content"])
    for q in (f'"{WORDS[5]}"', '"e"', '"t a" NEAR/9 "on"', f'!"{WORDS[7]}"'):
        assert sorted(map(tuple, index.match(q).collect())) == sorted(map(tuple, S.match(filled, q, key="n").select("n", "term_hits").collect()))
    wanted = sorted((r[0], r[1], i + 1, (r[2] + P.END)[i : i + 2]) for r in ROWS if r[2] for i in range(len(r[2])))
    got = index.rows().select("key", "canon", F.explode("places"), "pair").collect()
    assert sorted(map(tuple, got)) == wanted


def test_numbers_in_bytes():
    numbers = np.array([1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, 5], np.int64)
    coded, sizes = P._packed(numbers)
    assert sizes.tolist() == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 1] and P._unpacked(coded).tolist() == numbers.tolist()
    assert P._packed(numbers[:0])[0].tolist() == [] and P._unpacked(coded[:0]).tolist() == []


def test_settled_answers_read_the_texts_of_a_page(spark, docs, tmp_path, monkeypatch):
    """For NEAR and exclusion all matching texts were read; now those of the page, and the answers are those of a scan."""
    index = P.build(docs, f"file://{tmp_path}/i", "n", ["content"], "canon", buckets=4)
    scan, read = E.all_in_one, []
    monkeypatch.setattr(P.endpoints, "all_in_one", lambda texts, *more: read.append(texts.count()) or scan(texts, *more))
    whole = docs.fillna("", ["content"])
    for q in ('"e" NEAR/3 "st"', '"e" NEAR/3 "e"', '"st" -"sto"', '"st" -"ast" "on" ("e" | "q") !"zz"', '"e" NEAR/3 "st" "ee" -"eet" "e" NEAR/3 "st"', '"zz" NEAR/2 "e"'):
        one = index.all_in_one(q, order="canon-,term_hits", start=2, rows=5, around=4, facets=["canon"])
        two = scan(whole, "n", "content", q, order="canon-,term_hits", start=2, rows=5, around=4, facets=["canon"])
        assert [tuple(r) for r in one.results.select("n", "term_hits", "canon", "kwics").collect()] == [tuple(r) for r in two.results.select("n", "term_hits", "canon", "kwics").collect()]
        assert sorted(map(tuple, one.total.collect())) == sorted(map(tuple, two.total.collect())) and sorted(map(tuple, one.facets.collect())) == sorted(map(tuple, two.facets.collect()))
    assert len(read) == 6 and max(read) == 5


@pytest.mark.parametrize("terms", [("the", "in the"), ("in the", "the")])
def test_the_rarer_term_of_a_chain_goes_to_three_buckets(spark, terms):
    text = "the " * 500 + "in the " * 20
    places = lambda t, name: spark.createDataFrame([(1, [i + 1 for i in range(len(text)) if text.startswith(t, i)])], "k long, x array<int>").select("k", F.explode("x").alias(name))
    found = kwic.chain(places, "k", terms, [7])
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    got = sorted((r.p1, r.p2) for r in found.collect())
    at = {t: [i + 1 for i in range(len(text)) if text.startswith(t, i)] for t in terms}
    near = lambda a, b: (b - a - len(terms[0]) if b >= a else a - b - len(terms[1])) <= 7
    assert got == sorted((a, b) for a in at[terms[0]] for b in at[terms[1]] if near(a, b))
    most = 0
    for i in range(before, store.executionsList().size()):
        run = store.executionsList().apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())] if node.name() == "Generate" else []
            most = max([most, *[int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]])
    assert 500 <= most <= 520  # not three times as many
