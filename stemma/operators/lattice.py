"""Word segmentation by the best path through a lattice of dictionary words.

Between punctuation every dictionary word that stands somewhere is an edge, and so is every single character. An edge's
weight is the scaled logarithm of its word's share in a segmented sample, with a bonus for each further dictionary that
holds it; the path of the greatest sum is taken, of equal ones the one of fewer words, and then the one whose earlier
words are longer. Runs of digits and of Latin letters are one word each. Weights are whole numbers, so sums and ties don't
depend on the order in which they are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ignored

SCALE = 1000
UNSEEN = 0.5  # what a word that the sample lacks counts as
MOST_WORDS = 1_000_000
_LETTERS = r"[A-Za-zÀ-ɏḀ-ỿ]+"
_PART = re.compile(rf"(\d+|{_LETTERS}|[{re.escape(ignored(digits=True, space=False))}\s]+)")
_WORDLIKE = re.compile(rf"\d+|{_LETTERS}")


def word_weights(segmented: DataFrame, column: str, dictionaries: Mapping[str, DataFrame] | None = None, bonus: Mapping[str, float] | None = None, separator: str = "/") -> DataFrame:
    """word, weight of the words of a segmented column and of the dictionaries (a column of words each).

    bonus: what a dictionary adds to the logarithm of its words' shares.
    """
    said = segmented.select(F.explode(F.split(column, re.escape(separator))).alias("word")).where("word <> ''")
    counts = said.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"), F.lit(0.0).alias("extra"))
    rows = counts
    for name, words in (dictionaries or {}).items():
        more = words.select(F.col(words.columns[0]).alias("word")).where("word <> ''").distinct()
        rows = rows.unionByName(more.withColumns({"n": F.lit(0.0), "extra": F.lit(float((bonus or {}).get(name, 0.0)))}))
    each = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("extra").alias("extra"))
    total = said.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    share = F.log((F.col("n") + UNSEEN) / F.col("total")) + F.col("extra")
    return each.join(F.broadcast(total)).select("word", F.round(share * SCALE).cast("int").alias("weight"))  # one row


def best_path(text: str, weights: Mapping[str, int], longest: int, unknown: int) -> list[str]:
    """The words of a text without punctuation; unknown: the weight of a character that is no word of its own."""
    n = len(text)
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # (sum, less the number of words) from each place on
    size = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        top = None
        for k in range(min(longest, n - i), 0, -1):  # longer words first: they win ties
            w = weights.get(text[i : i + k], unknown if k == 1 else None)
            if w is None:
                continue
            value = (w + best[i + k][0], best[i + k][1] - 1)
            if top is None or value > top:
                top, size[i] = value, k
        best[i] = top
    out, i = [], 0
    while i < n:
        out.append(text[i : i + size[i]])
        i += size[i]
    return out


def words_of(text: str, weights: Mapping[str, int], longest: int, unknown: int, whole: bool = True) -> list[str]:
    """The words of a whole text; punctuation goes. whole: runs of digits or Latin letters aren't cut."""
    out = []
    for part in _PART.split(text):
        if not part or (_PART.fullmatch(part) and not _WORDLIKE.fullmatch(part)):
            continue
        if whole and _WORDLIKE.fullmatch(part):
            out.append(part)
        else:
            out += best_path(part, weights, longest, unknown)
    return out


def segment(docs: DataFrame, content: Column, words: DataFrame, key: str, separator: str = "/", name: str = "segmented", whole: bool = True) -> DataFrame:
    """docs with the segmented text. words: word, weight; key: unique in docs.

    Up to MOST_WORDS words go to every worker; of a larger dictionary each text gets the words that it holds, by a join.
    """
    words = words.where("word <> ''").groupBy("word").agg(F.max("weight").alias("weight"))
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("word")), F.lit(1)), F.coalesce(F.min("weight"), F.lit(0))).first()
    longest, unknown = size[1], size[2] - SCALE  # a character that is no word costs more than any word

    if size[0] <= MOST_WORDS:
        shared = docs.sparkSession.sparkContext.broadcast({r.word: r.weight for r in words.collect()})

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = shared.value
            for texts in batches:
                yield texts.map(lambda t: None if t is None else separator.join(words_of(t, weights, longest, unknown, whole)))

        return docs.withColumn(name, run(content))

    @F.pandas_udf("string")
    def run_own(texts: pd.Series, own: pd.Series) -> pd.Series:
        known = [{x["w"]: x["n"] for x in (o if o is not None else [])} for o in own]
        return pd.Series([None if t is None else separator.join(words_of(t, w, longest, unknown, whole)) for t, w in zip(texts, known)])

    places = F.sequence(F.lit(1), F.greatest(F.length(content), F.lit(1)))
    pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substring(content, i, n)))))
    held = docs.select(F.col(key).alias("_key"), F.explode(pieces).alias("word")).join(words, "word").groupBy("_key").agg(F.collect_list(F.struct(F.col("word").alias("w"), F.col("weight").alias("n"))).alias("_own"))
    return docs.join(held, docs[key] == held["_key"], "left").withColumn(name, run_own(content, F.col("_own"))).select(*docs.columns, name)
