"""Every operator and stage on nulls, empty and long texts, repeated rows, an empty table, and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import bradley_terry, decontaminate, fill_in_middle, importance, language_id, license_scan, minhash_forest, passages, piece_bpe, quality_rules, suffix_dedup, token_counts, token_files
from stemma.llm.queries import tokenizer
from stemma.llm.workspace import Workspace

PIECES = open(tokenizer("piece_bpe_32k.model"), "rb").read()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, a int, b string, digest string, content string, tokens string, pos int, id int, seed int, component long"
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
LONG = " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(60_000))
PASSAGE = " ".join(f"w{i}" for i in range(80))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, "b", "d", "c", "t", 3, 4, 5, 6)


ROWS = [
    row(1, None), row(2, ""), row(3, " \n\t "), row(4, "x"), row(5, LONG), row(6, "MIT License " * 30, None, None), row(7, PASSAGE), row(7, PASSAGE),
    row(8, "before it " + PASSAGE + " after"), row(None, PASSAGE), row(9, "日本語 ünïcödé 🎉 " * 40), row(9, "another text of the same id"), row(10, "a" * 500),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(7, 1), (4, 0), (5, 1), (2, 0), (None, 1), (8, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (1, PASSAGE), (None, PASSAGE)], "item_id long, text string")

    def scored(d):
        return bradley_terry.score(d, "doc_id", "text", bradley_terry.train(d, "doc_id", "text", labels, "quality", F.lit(True)))

    return {
        "scored": scored,
        "leaks": lambda d: decontaminate.find_leaks(d, "doc_id", "text", items, "item_id", "text"),
        "rules": lambda d: quality_rules.judge(d, "text", "lang", "source", ["doc_id"]),
        "suffix": lambda d: suffix_dedup.dedup_digests(d, "doc_id", "text"),
        "pieces": lambda d: piece_bpe.encode_digests(d, "doc_id", "text", PIECES),
        "files": lambda d: token_files.token_file_digests(d, "doc_id", "text", tokenizer("byte_bpe_50k.json"), 2),
        "licences": lambda d: license_scan.report(license_scan.scan(d, "doc_id", "text"), "doc_id"),
        "passages": lambda d: passages.find_passages(d, "doc_id", "text"),
        "counts": lambda d: token_counts.count_tokens(d, "doc_id", "text", tokenizer("piece_bpe_32k.model"), Workspace(spark, "t").path("cache")),
        "forest": lambda d: minhash_forest.near_duplicates(d, "doc_id", "text"),
        "resampled": lambda d: importance.resample(d, "doc_id", "text", items, "text"),
        "languages": lambda d: language_id.predict(d, "doc_id", "text", language_id.train(d, "text", "lang", F.lit(True))),
        "filled": lambda d: fill_in_middle.digests(d, "doc_id", "text"),
    }


PER_ROW = ["scored", "rules", "suffix", "pieces", "files", "licences", "counts", "forest", "resampled", "languages", "filled"]


@pytest.mark.parametrize("name", PER_ROW)
def test_row_for_each_row(spark, odd, none, name):
    op = operators(spark)[name]
    out = op(odd).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert op(none).count() == 0


def test_values(spark, odd):
    ops = operators(spark)
    rules = {(r.doc_id, r.n_words) for r in ops["rules"](odd).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (5, 60_000)} <= rules
    pieces = {r.doc_id: r.n_tokens for r in ops["pieces"](odd).where("doc_id < 3").collect()}
    assert pieces == {1: 1, 2: 1}
    counts = {r.doc_id: r.n_tokens for r in ops["counts"](odd).where("doc_id < 3").collect()}
    assert counts == {1: 0, 2: 0}
    found = {r.doc_id: r for r in ops["licences"](odd).collect()}
    assert found[6].n_base == 30 and found[6].labels == "mit" and found[1].first_word is None and found[1].score == 0.0


def test_passages_and_leaks(spark, odd, none):
    ops = operators(spark)
    spans = {(r.key, r.source, r.start, r.stop) for r in ops["passages"](odd).collect()}
    assert spans == {(7, None, 0, 80), (8, None, 2, 82)}  # the row without a key comes first
    kept = passages.remove_passages(odd, "doc_id", "text", ops["passages"](odd)).collect()
    assert {r.doc_id for r in kept} == {None, 1, 2, 3, 4, 5, 6, 8, 9, 10} and {r.text for r in kept if r.doc_id == 9} == {x[1] for x in ROWS if x[0] == 9}
    leaks = {(r.doc_id, r.item_id, r.kind) for r in ops["leaks"](odd).collect()}
    assert leaks == {(7, 1, "literal"), (8, 1, "literal")}
    assert ops["passages"](none).count() == 0 and ops["leaks"](none).count() == 0


def test_forest_components(spark, odd):
    out = {(r.doc_id, r.component_id, r.kept) for r in operators(spark)["forest"](odd).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (7, 7, True), (8, 7, False), (None, None, True), (10, 10, True)} <= out


def test_stages(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/out")
            assert spark.read.parquet(f"{tmp_path}/out").count() <= docs.count()
