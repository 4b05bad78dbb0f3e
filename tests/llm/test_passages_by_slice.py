"""Words of many small texts are hashed and compared by slices of a batch, not text by text, with the same rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import passages


def _texts():
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    repeats = [" ".join((["a", "b", "c", "d", "e", "f"][:n] * 60)[:200]) for n in range(1, 7)]
    odd = ["", "x", "b a b a", *repeats, f"{say(30)} {repeats[0]} {say(40)} {repeats[2]}", repeats[1]]
    shared = say(60)
    return odd + [f"{say(rng.randrange(60))} {shared} {say(rng.randrange(60))} {shared}" for _ in range(200)] + odd


@pytest.fixture(scope="module")
def inputs():
    """function -> batch of its input, a row for each text that has something to look at."""
    rng, texts = np.random.default_rng(9), _texts()
    seeds = pa.Table.from_batches(passages._seeds(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])]))).to_pylist()
    places = [[{"seed": s["seed"], "pos": s["pos"], "open": bool(rng.random() < 0.3), "asked": bool(rng.random() < 0.6)} for s in seeds if s["key"] == k and not s["n"]] for k in range(len(texts))]
    segments = [[{"seed": s["seed"], "digest": s["digest"], "n": s["n"], "lo": s["pos"] - s["off"], "times": 1} for s in seeds if s["key"] == k and s["n"]] for k in range(len(texts))]
    place = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_()), ("asked", pa.bool_())]))
    segment = pa.list_(pa.struct([("seed", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("lo", pa.int32()), ("times", pa.int64())]))
    keys, text, n = pa.array(range(len(texts))), pa.array(texts), len(texts)
    first = pa.array(np.zeros(n, np.int32))
    words = [w.tobytes() for w in (np.arange(1, 70, dtype=np.uint32) for _ in range(n))]
    at = pa.array([[5]] * n, pa.list_(pa.int32()))
    long = [k for k, t in enumerate(texts) if len(t.split()) > 20]
    aligned = pa.RecordBatch.from_arrays([keys, keys, at, at, pa.array(words), text], ["key", "source", "d", "r", "words", "text"])
    return {
        "_arounds": pa.RecordBatch.from_arrays([keys, text, pa.array(places, place)], ["key", "text", "seeds"]),
        "_windows": pa.RecordBatch.from_arrays([keys, text, pa.array(segments, segment)], ["key", "text", "segments"]),
        "_regions": pa.RecordBatch.from_arrays([keys, first, pa.array(np.full(n, 30, np.int32)), text], ["key", "r_first", "r_last", "text"]),
        "_aligned": aligned.take(pa.array(long)),
    }


@pytest.mark.parametrize("name", ["_arounds", "_windows", "_regions", "_aligned"])
def test_texts_of_a_batch_at_once(inputs, monkeypatch, name):
    """_arounds, _windows, _regions and _aligned called word_hashes for each text: 1263 CPU seconds a GB."""
    calls, hashes = [], passages.word_hashes

    def counted(raw, offsets):
        calls.append(len(offsets))
        return hashes(raw, offsets)

    monkeypatch.setattr(passages, "word_hashes", counted)
    run, batch = getattr(passages, name), inputs[name]
    rows = lambda batches: sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=repr)
    together = rows(run(iter([batch])))
    assert len(calls) <= 2
    alone = rows(b for k in range(batch.num_rows) for b in run(iter([batch.slice(k, 1)])))
    assert together == alone and (together or name == "_aligned")


def test_stretches_of_windows():
    held = [[{"i": 2, "source": 1, "r": 9}, {"i": 0, "source": 1, "r": 7}, {"i": 1, "source": 1, "r": 8}, {"i": 4, "source": 1, "r": 11}, {"i": 5, "source": 2, "r": 12}, {"i": 6, "source": 2, "r": 14}], [{"i": 7, "source": 2, "r": 15}]]
    kind = pa.list_(pa.struct([("i", pa.int32()), ("source", pa.int64()), ("r", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([8, 8], pa.int32()), pa.array(held, kind)], ["seed", "digest", "n", "held"])
    out = [tuple(r.values())[3:] for b in passages._intervals(iter([batch])) for r in b.to_pylist()]
    assert out == [(0, 3, 1, 7), (4, 1, 1, 11), (5, 1, 2, 12), (6, 1, 2, 14), (7, 1, 2, 15)]


def test_firsts_equal_brute_force():
    rng = np.random.default_rng(4)
    doc, hashes = np.sort(rng.integers(0, 20, 500)), rng.integers(0, 9, 500).astype(np.uint64)
    seen, wanted = set(), []
    for x in zip(doc.tolist(), hashes.tolist()):
        wanted.append(x not in seen)
        seen.add(x)
    assert passages._first_of(doc, hashes).tolist() == wanted
    assert not len(passages._first_of(doc[:0], hashes[:0]))


def test_collinear_matches_are_one_chain():
    d, r = np.array([3, 9, 40]), np.array([103, 110, 141])
    assert [x.tolist() for x in passages.chain(d, r, np.zeros(3, bool))] == [[0, 1, 2]]
    assert [x.tolist() for x in passages.chain(d[:1], r[:1], np.ones(1, bool))] == [[0]]
    assert passages.chain(d[:1], r[:1], np.zeros(1, bool)) == []
