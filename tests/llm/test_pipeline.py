"""Each stage of the pipeline against brute force, on the smallest table and rows that share or lack their doc_id."""

import collections
import hashlib
import itertools
import math
import os
import re

import pytest

import corpus_pipeline
from stemma.llm import passages, quality_rules as Q
from stemma.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
say = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """(folder with documents and benchmark, the tables that the stages leave in turn)."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    item = max((r.text for r in items.collect()), key=lambda t: len(t.split()))
    lone, other = say("lone", 120), say("other", 300)
    extra = [
        (5000, lone), (5000, other), (5001, other.replace("other7 ", "")), (5000, f"{say('x', 100)} {item} {say('y', 100)}"),
        (None, say("null", 90)), (None, say("null", 90)), (None, lone + " end of it"), (5002, f"{say('own', 200)} {say('lone', 80)} {say('tail', 60)}"),
        (5003, " ".join(["again and again"] * 60)), (5003, say("kept", 70)), (5004, None), (5004, ""),
    ]
    rows = spark.createDataFrame([(k, t, "en", "src1", None if t is None else len(t)) for k, t in extra], docs.schema)
    docs.unionByName(rows).write.parquet(f"{root}/documents.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    tables = [spark.read.parquet(f"{root}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], root).write.parquet(f"{root}/stage-{i}")
        tables.append(spark.read.parquet(f"{root}/stage-{i}"))
    return root, [t.collect() for t in tables]


def counted(rows, *fields):
    return collections.Counter(tuple(r[f] for f in fields) for r in rows)


def measured(text):
    w, t = words_of(text), text or ""
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if words_of(x)]
    sizes = {"word_chars": sum(map(len, w)), "n_lines": len(lines), "n_words": len(w)}
    n = {"symbol_share": len(re.findall(r"[#*$%&|<>]", t)), "dup_line_share": len(lines) - len(set(lines)), "repeat_share": repeat, "upper_share": len(re.findall("[A-Z]", t)), "bar_share": t.count("|")}
    return sizes, {k: n[k] / sizes[size] if sizes[size] else 0.0 for k, (size, _) in Q.RULES.items()}, len(w) >= 50 and 100 * repeat <= 50 * len(w)


def test_rules(inputs):
    before, after = inputs[1][:2]
    seen = [(r, *measured(r.text)) for r in before]
    want = collections.Counter()
    for r, sizes, shares, base in seen:
        groups = [[x[2] for x in seen if (x[0].lang, x[0].source) == (r.lang, r.source)], [x[2] for x in seen if x[0].lang == r.lang], [x[2] for x in seen]]
        group = next((g for g in groups if len(g) >= Q.MIN_GROUP), groups[-1])
        for name, (size, event) in Q.RULES.items():
            values = sorted(x[name] for x in group)
            middle, upper = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (Q.MIDDLE, Q.UPPER))
            base = base and shares[name] <= upper + Q.REACH * max(upper - middle, event / max(sizes[size], 1))
        want[(r.doc_id, r.text)] += base
    assert counted(after, "doc_id", "text") == +want and len(after) > len(before) / 2


def test_near_duplicates(inputs):
    before, after = inputs[1][1:3]
    texts = sorted({r.text for r in before})

    def shingles(text):
        w = words_of(text.translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {t: shingles(t) for t in texts}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for r in before:
        groups[find(r.text)].append((-1 if r.doc_id is None else r.doc_id))
    kept = collections.defaultdict(list)
    for r in after:
        kept[find(r.text)].append((-1 if r.doc_id is None else r.doc_id))
    assert {g: [min(x)] for g, x in groups.items()} == dict(kept)  # the smallest doc_id of each group, without an id first
    assert not counted(after, "doc_id", "text") - counted(before, "doc_id", "text") and len(after) > len(before) / 2


def test_repeated_passages(inputs):
    before, after = inputs[1][2:4]
    order = sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    w = [words_of(r.text) for r in order]
    low = [[x.translate(LOWER) for x in ws] for ws in w]
    left = collections.defaultdict(list)
    for r in after:
        left[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    holder, fives = {}, collections.defaultdict(set)
    changed = 0
    for i, ws in enumerate(low):
        same_id = [t for t in left[order[i].doc_id]]
        runs = {k for k in range(len(ws) - 29) if tuple(ws[k : k + 30]) in holder and order[holder[tuple(ws[k : k + 30])]] is not order[i]}
        if order[i].text in same_id:
            assert not runs  # nothing equal stays in a text that was left as it is
        elif not (runs and all(any(k <= j < k + 30 for k in runs) for j in range(len(ws)))):
            changed += 1
            mine = next((t for t in same_id if words_of(t) and set(words_of(t)) <= set(w[i])), "")
            rest = iter(w[i])
            assert all(x in rest for x in words_of(mine))  # what is left is the text less some words, in order
            gone = len(ws) - len(words_of(mine))
            shared = sum(any(tuple(ws[k : k + 5]) in fives for k in range(max(0, j - 4), j + 1)) for j in range(len(ws)))
            assert gone >= passages.MIN_WORDS and gone * passages.IDENTITY <= shared + 10
        for k in range(len(ws) - 29):
            holder.setdefault(tuple(ws[k : k + 30]), i)
        for k in range(len(ws) - 4):
            fives[tuple(ws[k : k + 5])].add(i)
    assert changed and any(r.text == say("lone", 120) + " end of it" for r in after)
    assert [r.text for r in after if r.doc_id == 5002] == [f"{say('own', 200)} {say('tail', 60)}"]
    assert say("kept", 70) in left[5003] and len(after) > 0.9 * len(before)


def test_leaks(inputs, spark):
    before, after = inputs[1][3:5]
    items = [r.text for r in spark.read.parquet(f"{inputs[0]}/benchmark.parquet").collect()]
    want = [r for r in before if not any(x in r.text for x in items)]
    assert counted(after, "doc_id", "text") == counted(want, "doc_id", "text") and len(want) < len(before)


def test_tokens(inputs):
    import sentencepiece

    before, after = inputs[1][4:6]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in before:
        ids = sp.encode(r.text, add_eos=True)
        want[(r.doc_id, len(ids), tuple(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in after) == want
