"""The queries of this subpackage, by the names under which the driver runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bradley_terry, decontaminate, fill_in_middle, importance, language_id, license_scan, minhash_forest, passages, quality_rules, suffix_dedup
from .piece_bpe import encode_digests
from .sql import SQL  # noqa: F401
from .token_counts import count_tokens
from .token_files import token_file_digests
from .workspace import Workspace


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = bradley_terry.train(docs, "doc_id", "text", labels, "quality", ~held_out)
    scored = bradley_terry.score(docs, "doc_id", "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), "text", "lang", "source", ["doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(documents(spark, sf_dir), "doc_id", "text")


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        return encode_digests(documents(spark, sf_dir), "doc_id", "text", f.read())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(documents(spark, sf_dir), "doc_id", "text", tokenizer("byte_bpe_50k.json"), end_id=2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(documents(spark, sf_dir), "doc_id", "text"), "doc_id")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id repeats words [start, stop) of an earlier document, source_id."""
    found = passages.find_passages(documents(spark, sf_dir), "doc_id", "text")
    return found.drop("version").withColumnsRenamed({"key": "doc_id", "source": "source_id"})


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, which a first batch fills: the whole table finds those counts and adds the rest."""
    cache, path = Workspace(spark, "token-cache").path("cache"), tokenizer("piece_bpe_32k.model")
    docs = documents(spark, sf_dir)
    count_tokens(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0), "doc_id", "text", path, cache)
    return count_tokens(docs, "doc_id", "text", path, cache).withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(documents(spark, sf_dir), "doc_id", "text")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    predicted = language_id.predict(docs, "doc_id", "text", language_id.train(docs, "text", "lang", ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry, op2_decontaminate, op3_quality_rules, op4_suffix_dedup, op5_piece_bpe, op6_token_files, op7_license_scan, op8_passages, op9_token_counts, op10_minhash_forest,
        op11_importance, op12_language_id, op13_fill_in_middle,
    )
}
