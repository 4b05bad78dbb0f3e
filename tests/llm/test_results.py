"""Results against brute force on the smallest table, and round trips."""

import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stemma.llm import induced_sort, license_rules, license_scan, minhash_forest, passages, piece_bpe, quality_rules, queries, simple8b, suffix_dedup, token_counts
from stemma.llm.library_tokens import LibraryTokenizer, read
from stemma.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_quality_rules(spark, docs):
    for r in run(spark, "op3_quality_rules"):
        text = docs[r.doc_id]
        w = words_of(text)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.base_failed or not r.kept)


def test_quality_fences_follow_the_habits_of_a_source(spark):
    plain = [f"w{i}" for i in range(80)]
    marks = lambda n: " ".join(["#"] * n + plain)
    rows = [("en", "tables", marks(10 + i % 11)) for i in range(150)] + [("en", "prose", marks(0)) for _ in range(150)]
    rows += [("en", s, marks(n)) for s in ("tables", "prose", "few") for n in (1, 3, 12, 200)]
    rows += [("xx", "few", marks(n)) for n in (12, 200)] + [(None, None, marks(0))]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = {(r.lang, r.source, r.n_symbols): r.kept for r in quality_rules.judge(frame, "text", "lang", "source", ["lang", "source"]).collect()}
    assert [kept["en", "tables", n] for n in (1, 3, 12, 200)] == [True, True, True, False]
    assert [kept["en", "prose", n] for n in (1, 3, 12, 200)] == [True, True, False, False]  # the same text with 12 marks
    assert [kept["en", "few", n] for n in (12, 200)] == [True, False]  # too few texts: the language's habit
    assert [kept["xx", "few", n] for n in (12, 200)] == [True, False] and kept[None, None, 0]  # that of the whole


def expected_without_repeats(raw):
    """(bytes, removed, spans, digest of what stays) for each of raw by counting all 200-byte strings."""
    count = collections.Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    for b in raw:
        runs = []
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + 200
                else:
                    runs.append([k, k + 200])
        kept, at = b"", 0
        for x, y in runs:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        yield len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("shard", [2 << 20, 4000, 500])
def test_suffix_dedup(spark, docs, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "GROUP", shard)  # the driver's side alone: small shards make anchors hot, the smallest beyond all splits
    want = dict(zip(docs, expected_without_repeats([t.encode() for t in docs.values()])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op4_suffix_dedup")}
    assert got == want


def test_suffix_dedup_of_rows_with_shared_and_null_keys(spark):
    rng = np.random.default_rng(3)
    say = lambda n: "".join(rng.choice(list("abcdé "), n))
    one, two, plate = say(559), say(700), say(230)
    rows = [(5, one), (5, one), (None, one), (6, two), (6, "x" + two[100:400] + say(90)), (None, None), (None, say(300)), (7, say(150))]
    rows += [(8, say(40) + plate + f"{i} " + plate[::-1]) for i in range(12)] + [(9, "é" * 300), (9, "é" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup_digests(frame, "doc_id", "text").collect()
    want = [(k, *x) for (k, _), x in zip(rows, expected_without_repeats([(t or "").encode() for _, t in rows]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(deadline=None)
def test_suffix_array(symbols):
    t = np.array([*symbols, 0])
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    sa = induced_sort.suffix_array(t, 5)
    assert sa.tolist() == order
    before, length = induced_sort.permuted_common_prefixes(t, sa)
    for x, y in zip(order, order[1:]):
        common = next(k for k in itertools.count() if max(x, y) + k >= len(t) or t[x + k] != t[y + k])
        assert before[y] == x and length[y] == common


def test_pieces_of_long_words():
    """Words of over 1,000 characters take another path."""
    import random

    import sentencepiece

    proto = open(queries.tokenizer("piece_bpe_32k.model"), "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é日a🎉", "a") for n in (999, 1000, 1001, 1500, 6000)]
    texts.append(" ".join(texts))
    for text in texts:
        ids, _ = piece_bpe.encode_texts(pa.array([text]), proto)
        assert ids.tolist() == sp.encode(text, add_eos=True)


def test_words_do_not_depend_on_chunks(monkeypatch):
    from stemma.llm import words
    from stemma.llm.arrow_text import flat

    column = pa.array(["one two  three\n" * 40, "", "x" * 900, "   ", "end é日 " * 60, "tail"])
    whole = words.word_hashes(*flat(column))
    for chunk in (64, 333, 1000):
        monkeypatch.setattr(words, "CHUNK", chunk)
        assert all((a == b).all() for a, b in zip(whole, words.word_hashes(*flat(column))))


def test_workspaces_of_other_threads_stay_open(spark):
    import threading

    from stemma.llm.workspace import _LIVE, closing

    with closing():
        mine = Workspace(spark, "mine")
        other = []
        t = threading.Thread(target=lambda: other.append(Workspace(spark, "other")))
        t.start()
        t.join()
    assert mine not in _LIVE and other[0] in _LIVE
    other[0].close()


def test_pieces_and_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in run(spark, "op5_piece_bpe"):
        ids = sp.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    for r in run(spark, "op9_token_counts"):
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


@given(st.text(alphabet=st.sampled_from(list(" ▁ab\nthe12,.é日🎉<>\t　's")), max_size=80))
@settings(deadline=None, max_examples=300)
def test_pieces_are_those_of_the_library(text):
    import sentencepiece

    proto = open(queries.tokenizer("piece_bpe_32k.model"), "rb").read()
    sp = test_pieces_are_those_of_the_library.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_proto=proto))
    ids, _ = piece_bpe.encode_texts(pa.array([text]), proto)
    assert ids.tolist() == sp.encode(text, add_eos=True)
    assert piece_bpe.coder(proto)[0].decode_ids(ids.tolist()) == sp.decode(ids.tolist())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_library_tokens(name, docs):
    texts = [*docs.values(), "", "<|endoftext|> in <|endoftext|>", "a\r\nb \n c", "it's we'll", "x" * 3000, " " * 40, "a　\nb", "é à, ü"]
    kind, blob = read(queries.tokenizer(name))
    coder = LibraryTokenizer(kind, blob)
    ids, ends = coder.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [list(x) for x in coder.whole(texts)]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    start = 0
    for r in sorted(run(spark, "op6_token_files")):
        ids = [*hf.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 1 << 16) | st.just(0), max_size=3000))
@settings(deadline=None)
def test_simple8b(values):
    v = np.array(values, np.uint64)
    coded = simple8b.encode(v)
    counts = np.full(len(coded.word_ends) - 1, simple8b.BLOCK)
    if len(v):
        counts[-1] = len(v) - simple8b.BLOCK * (len(counts) - 1)
    assert (simple8b.decode(coded.words, coded.escapes, coded.word_ends, counts) == v).all()


def test_digest_cache(spark, monkeypatch):
    cache = Workspace(spark, "cache-test").path("cache")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda d: {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, "doc_id", "text", queries.tokenizer("piece_bpe_32k.model"), cache).collect()}
    first = count(make([(1, "one two"), (2, "one two"), (3, None)]))
    assert spark.read.parquet(cache).count() == 2
    again = count(make([(4, "one two"), (5, "three")]))
    assert spark.read.parquet(cache).count() == 3 and again[4] == first[1]


def test_licences(spark, docs):
    table = [(r, re.compile(r.pattern)) for r in license_rules.rules()]
    for r in run(spark, "op7_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r.doc_id].translate(LOWER))
        text = " ".join(w)
        base = [(text[: m.start()].count(" "), label) for phrase, label in license_rules.BASE.items() for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", text)]
        spans = [(m.start(), m.end(), x.priority, x.order, x.label, x.score) for x, p in table if x.keyword in text and any(k in text for k in license_rules.GATE) for m in p.finditer(text)]
        strong = lambda a, b: (a[2], a[1] - a[0], -a[3]) > (b[2], b[1] - b[0], -b[3])
        found = [b for b in spans if not any(a is not b and a[0] <= b[0] and b[1] <= a[1] and a[2] >= b[2] and strong(a, b) for a in spans)]
        labels = {x for _, x in base}
        assert (r.n_words, r.n_base) == (len(w), len(base)) and r.base_labels == ",".join(sorted(labels))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.labels == ",".join(sorted(labels | {x[4] for x in found})) and r.n_found == len(found)


def test_licences_in_a_text_full_of_them(spark):
    text = "The MIT License and " * 40_000
    r = license_scan.report(license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text"), "doc_id").first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.n_found) == (160_000, 40_000, 1, 159_997, "mit", 40_000)


def test_licences_without_any_gate(spark, docs):
    texts = ["SPDX-License-Identifier: " + x for x in ("OFL-1.1", "BSL-1.0", "EPL-2.0", "OSL-3.0", "AFL-3.0", "ODbL-1.0", "MS-PL", "SSPL-1.0", "WTFPL")]
    texts += ["MPL 2.0", "This program is distributed in the hope that it will be useful, but without any warranty", "Confidential and proprietary information"]
    texts += ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"]
    texts += list(docs.values())
    table = [(r, re.compile(r.pattern)) for r in license_rules.rules()]
    strong = lambda a, b: (a[2], a[1] - a[0], -a[3]) > (b[2], b[1] - b[0], -b[3])
    rows = license_scan.report(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"), "doc_id").collect()
    for r in rows:
        text = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOWER)))
        spans = [(m.start(), m.end(), x.priority, x.order, x.label) for x, p in table for m in p.finditer(text)]
        found = [b for b in spans if not any(a is not b and a[0] <= b[0] and b[1] <= a[1] and a[2] >= b[2] and strong(a, b) for a in spans)]
        assert r.n_found == len(found) and {x[4] for x in found} <= set(r.labels.split(",")) and (r.doc_id > 12 or found)


def test_passages(spark, docs):
    w = {i: words_of(t.translate(LOWER)) for i, t in docs.items()}
    where = collections.defaultdict(set)
    for i, x in w.items():
        for k in range(len(x) - 50):
            where[tuple(x[k : k + 51])].add(i)
    need = {i for s in where.values() for i in s - {min(s)}}
    found = run(spark, "op8_passages")
    assert need <= {r.doc_id for r in found}
    for r in found:
        assert r.source_id < r.doc_id and r.n_equal >= passages.MIN_WORDS and r.identity >= passages.IDENTITY
        assert 0 <= r.start < r.stop <= len(w[r.doc_id])


def test_chains():
    d, r = np.array([0, 10, 20, 30]), np.array([100, 110, 5, 130])
    assert passages.chain(d, r, np.zeros(len(d), bool))[0].tolist() == [0, 1, 3]
    assert passages._without("a b  c\nd e", [(1, 3)]) == "a d e"


@pytest.mark.parametrize("shared, body", [(60, 80), (200, 300)])
def test_passages_around_an_unlike_body(spark, shared, body):
    say = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    rows = [(k, f"{say('head', shared)} {say(f'own{k}x', body)} {say('foot', shared)}") for k in (1, 2)]
    out = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.key, r.source, r.start, r.stop) for r in out) == [(2, 1, 0, shared), (2, 1, shared + body, 2 * shared + body)]


def test_passages_whose_seeds_stand_in_earlier_documents(spark):
    run = [f"w{i}" for i in range(51)]
    fill = lambda mark: " ".join(f"{mark}{i}" for i in range(30))
    rows = [(k, f"{fill(f'a{k}x')} {' '.join(run[k : k + 12])} {fill(f'b{k}x')}") for k in range(40)]  # hold all seeds, no passage
    rows += [(k, f"{fill(f'c{k}x')} {' '.join(run[:n])} {fill(f'd{k}x')}") for k, n in ((100, 51), (101, 51), (102, 30))]
    out = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.key, r.source, r.start, r.stop) for r in out) == [(101, 100, 30, 81), (102, 100, 30, 60)]


def test_passages_split_over_earlier_documents(spark):
    run = [f"w{i}" for i in range(60)]
    rows = [(k, f"{' '.join(f'a{k}x{i}' for i in range(40))} {' '.join(run[6 * k : 6 * k + 30])}") for k in range(6)]  # 30 of the words each
    rows += [(k, f"{' '.join(f'b{k}x{i}' for i in range(50))} {' '.join(run)}") for k in (10, 11)]
    out = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    for key in (10, 11):
        assert {i for r in out if r.key == key for i in range(r.start, r.stop)} == set(range(50, 110))
    assert 10 in {r.source for r in out if r.key == 11}


def test_passages_of_rows_that_share_a_key(spark):
    say = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    rows = [(1, say("one", 100)), (2, f"{say('own', 200)} {say('one', 80)}"), (2, say("unlike", 120))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = passages.remove_passages(frame, "doc_id", "text", passages.find_passages(frame, "doc_id", "text")).collect()
    assert {(r.doc_id, r.text.strip()) for r in left} == {(1, say("one", 100)), (2, say("own", 200)), (2, say("unlike", 120))}


def test_passages_cover_all_equal_runs(spark, docs):
    w = {i: words_of(t.translate(LOWER)) for i, t in docs.items()}
    least = {}
    for i in sorted(w):
        for k in range(len(w[i]) - 29):
            least.setdefault(tuple(w[i][k : k + 30]), i)
    covered = collections.defaultdict(set)
    for r in run(spark, "op8_passages"):
        covered[r.doc_id].update(range(r.start, r.stop))
    for i, x in w.items():
        for k in range(len(x) - 29):
            assert least[tuple(x[k : k + 30])] == i or covered[i].issuperset(range(k, k + 30))


def shingles(text):
    w = words_of(text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_forest(spark, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op10_minhash_forest")}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_forest_splits_large_regions(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(j % 190 for j in range(300))]
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.component_id for r in out.collect()} == {0}


@pytest.mark.parametrize("rows", [(45, 45), (1, 3), (20_480, 30)])
def test_forest_hands_on_regions_that_a_border_cuts(rows):
    """Every row of a cut region goes to the join by rare shingles, on both sides, however few there are."""
    rng = np.random.default_rng(1)

    def batch(n, start):
        fixed = lambda w: pa.array([rng.integers(0, 256, w, dtype=np.uint8).tobytes() for _ in range(n)], pa.binary())
        order = pa.array([b"\0\1\0\2" + bytes([i >> 8, i & 255] * 6) for i in range(n)], pa.binary())
        keys = pa.array(np.arange(start, start + n))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), order, keys, fixed(16), keys], ["tree", "order", "key", "sketch", "component"])

    for n, start in zip(rows, (0, rows[0])):
        out = pa.Table.from_batches(minhash_forest._walk(False)(iter([batch(n, start)])))
        crowded = {a for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()) if a == b}
        assert crowded == set(range(start, start + n)) and set(out["region"].to_pylist()) == {(1 << 16) | 2}


def test_forest_of_texts_on_one_template(spark):
    shared = [f"t{i}" for i in range(204)]
    own = lambda mark, n: [f"{mark}x{i}" for i in range(n)]
    rows = [(i, " ".join(shared + own(f"a{i}", 43))) for i in range(800)]  # 0.70 with each other
    for k in range(100):  # pairs of 0.77, far apart in the order of keys
        both = own(f"p{k}", 12)
        rows += [(3000 + k, " ".join(shared + both + own(f"b{k}", 31))), (9000 - k, " ".join(shared + both + own(f"c{k}", 31)))]
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 12000 - i if i > 8000 else i for i, _ in rows}


def test_leaks(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in run(spark, "op2_decontaminate")}
    assert found == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}


def test_reparameterised_leaks(spark):
    from stemma.llm.decontaminate import find_leaks

    item = "If Anna buys 12 apples for 3 dollars each and sells 12 apples for 5 dollars each how much money has Anna made on that day"
    texts = {
        1: item,
        2: "Yesterday: " + item.replace("12", "40").replace(" 3 ", " 2 ").replace("dollars", "euros").replace("Anna", "Bert"),
        3: item.replace("12", "40", 1),  # one value twice in the item, two values here
        4: "If nobody buys anything for any price then how much money has been made on that day in the end",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = find_leaks(docs, "doc_id", "text", spark.createDataFrame([(7, item)], "item_id long, text string"), "item_id", "text")
    assert {(r.doc_id, r.kind) for r in out.collect()} == {(1, "literal"), (2, "reparameterised")}


def test_leaks_of_short_dense_and_edited_items(spark):
    from stemma.llm.decontaminate import find_leaks

    say = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    long = "in which of these 3 towns did the old clock strike 3 times while all the people of the market stood and looked at it"
    items = {1: "What is 17 times 23?", 2: "17 23 9 8 7 6 5 4 3 and 12 13", 3: "the", 4: long, 5: "日本の首都はどこですか、次の四つの中から", 6: "9 8 7 6 5 4 3"}
    texts = {
        1: f"{say('a', 40)} what is 17 times 23? {say('b', 9)}", 2: f"{say('a', 40)} what is 17 times 24? {say('b', 9)}", 3: f"{say('a', 9)} {items[2]} the end",
        4: f"{say('a', 9)} {items[2].replace('9', '10')}", 5: f"{say('c', 9)} {long.replace('3 times', '4 times')} {say('d', 9)}", 6: f"これは、{items[5]}、です", 7: "the the the", 8: items[6],
    }
    frame = lambda rows, name: spark.createDataFrame(sorted(rows.items()), f"{name} long, text string")
    out = find_leaks(frame(texts, "doc_id"), "doc_id", "text", frame(items, "item_id"), "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 1), (3, 2), (5, 4), (6, 5)}


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op1_bradley_terry"](spark, sf)
    both = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in both if r.quality == 1], [r.score for r in both if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([r.predicted == r.quality for r in both]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect())
