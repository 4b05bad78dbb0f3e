"""Variants, synonyms and words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import hits
from .relations import pairs_within


def expansions(spark: SparkSession, query: str, variants: dict[str, str], docs: DataFrame | None = None, content: str = "content", segment: int = 60) -> DataFrame:
    """All spellings of the query: the product of each character's forms.

    Long products grow by segments of fewer than `segment` spellings; with docs, a segment's spellings that no text
    holds are dropped before the next one is added.
    """
    forms = [list(dict.fromkeys([c, *variants.get(c, "").split(",")])) for c in query]
    forms = [[x for x in f if x] for f in forms]
    groups: list[list[list[str]]] = [[]]
    for f in forms:
        size = reduce(lambda n, g: n * len(g), groups[-1], 1) * len(f)
        if groups[-1] and size >= segment:
            groups.append([])
        groups[-1].append(f)
    out = None
    for g in groups:
        part = spark.range(1).select(F.lit("").alias("s"))
        for f in g:
            part = part.select(F.explode(F.transform(F.array(*map(F.lit, f)), lambda x: F.concat(F.col("s"), x))).alias("s"))
        if docs is not None and len(query) > 4:
            part = held(docs, content, [r.s for r in part.collect()])  # fewer than segment times one character's forms
        out = part if out is None else out.crossJoin(part.withColumnRenamed("s", "t")).select(F.concat("s", "t").alias("s"))
    return out.distinct().withColumnRenamed("s", "spelling")


def spellings(words: DataFrame, column: str, variants: DataFrame) -> DataFrame:
    """word, spelling: all spellings of each word of a table, by a dictionary (k, vars: a character's forms, parted by commas).

    The characters are joined to the dictionary; a word's product grows inside its row. It is as large as the forms make
    it, so give words, not texts.
    """
    forms = variants.select(F.col("k").alias("_c"), F.explode(F.split("vars", ",")).alias("_f")).where("_f <> ''").groupBy("_c").agg(F.collect_set("_f").alias("_forms"))
    each = words.select(F.col(column).alias("word")).distinct().where("word is not null").select("word", F.posexplode(F.split("word", "")).alias("_at", "_c"))
    known = each.join(forms, "_c", "left").withColumn("_all", F.array_distinct(F.concat(F.array("_c"), F.coalesce("_forms", F.array().cast("array<string>")))))
    rows = known.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_all"))), lambda x: x["_all"]).alias("_p"))
    grown = F.aggregate("_p", F.array(F.lit("")), lambda done, of: F.flatten(F.transform(done, lambda s: F.transform(of, lambda x: F.concat(s, x)))))
    return rows.select("word", F.explode(grown).alias("spelling")).distinct()


def held(docs: DataFrame, content: str, spellings: Sequence[str]) -> DataFrame:
    """s: those of the spellings that some text holds, by one scan."""
    there = F.filter(F.array(*[F.lit(s) for s in dict.fromkeys(spellings)]), lambda s: F.contains(F.col(content), s))
    return docs.select(F.explode(there).alias("s")).distinct()


def without_ligatures(spellings: DataFrame, column: str, ligatures: dict[str, str]) -> DataFrame:
    """Spellings with each ligature written out; what becomes equal is one."""
    out = F.col(column)
    for joined, parts in ligatures.items():
        out = F.replace(out, F.lit(joined), F.lit(parts))
    return spellings.select(out.alias(column)).distinct()


def spelling_hits(docs: DataFrame, content: str, spellings: Sequence[str]) -> DataFrame:
    """spelling, hits of those that occur: one scan for all spellings, which come from one query and are few."""
    each = F.array(*[F.struct(F.lit(s).alias("spelling"), hits(F.col(content), s).alias("hits")) for s in dict.fromkeys(spellings)])
    rows = docs.select(F.explode(each).alias("x")).select("x.*")
    return rows.groupBy("spelling").agg(F.sum("hits").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "spelling")


def synonyms(groups: DataFrame, group: str, term: str, more: DataFrame | None = None) -> DataFrame:
    """term, synonyms: every other member of its groups, and pairs (term, synonym) of a second table both ways."""
    pairs = pairs_within(groups, group, term).select(F.col("a").alias("term"), F.col("b").alias("synonym"))
    if more is not None:
        pairs = pairs.union(more.select("term", "synonym")).union(more.select(F.col("synonym"), F.col("term")))
    return pairs.where("term <> synonym").groupBy("term").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def longest_match(words: frozenset[str], text: str, longest: int) -> list[str]:
    out, i = [], 0
    while i < len(text):
        n = next((k for k in range(min(longest, len(text) - i), 1, -1) if text[i : i + k] in words), 1)
        out.append(text[i : i + n])
        i += n
    return out


MOST_WORDS = 1_000_000


def segment(docs: DataFrame, content: Column, words: DataFrame, key: str, separator: str = "/") -> DataFrame:
    """docs with `segmented`: between punctuation the longest word of the dictionary (one column) at each place, else one
    character. A dictionary of up to MOST_WORDS words goes to every worker; of a larger one each text gets the words
    that it holds, by a join. key: unique in docs."""
    name = words.columns[0]
    words = words.select(F.col(name).alias("_word")).where(F.length("_word") > 1).distinct()
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("_word")), F.lit(1))).first()

    def cut_up(texts: pd.Series, known, longest: int) -> pd.Series:
        return pd.Series([None if t is None else separator.join(longest_match(w, t, longest)) for t, w in zip(texts, known)])

    if size[0] <= MOST_WORDS:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words.collect()))

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return cut_up(texts, [shared.value] * len(texts), size[1])

        return docs.withColumn("segmented", run(content))

    @F.pandas_udf("string")
    def run_own(texts: pd.Series, own: pd.Series) -> pd.Series:
        return cut_up(texts, [frozenset(x if x is not None else ()) for x in own], size[1])

    places = F.sequence(F.lit(1), F.greatest(F.length(content), F.lit(1)))
    pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(2), F.lit(max(2, size[1]))), lambda n: F.substring(content, i, n)))))
    own = docs.select(F.col(key).alias("_key"), F.explode(pieces).alias("_word")).join(words, "_word").groupBy("_key").agg(F.collect_set("_word").alias("_own"))
    return docs.join(own, docs[key] == own["_key"], "left").withColumn("segmented", run_own(content, F.col("_own"))).select(*docs.columns, "segmented")


def converted(docs: DataFrame, column: str, forms: dict[str, str], name: str = "converted") -> DataFrame:
    """docs with the text in other characters: the longest form of the dictionary at each place, as simplified to traditional."""
    known, longest = forms, max(map(len, forms), default=1)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        words = frozenset(known)
        return texts.map(lambda t: None if t is None else "".join(known.get(w, w) for w in longest_match(words, t, longest)))

    return docs.withColumn(name, run(F.col(column)))


def tag_scheme(words: Sequence[str], scheme: str = "SBIE") -> list[tuple[str, str]]:
    """(character, tag) of segmented words: S for single ones, B, I, E inside, or B, M1, M2, M, E."""
    out = []
    for w in words:
        if len(w) == 1:
            out.append((w, "S"))
            continue
        for i, c in enumerate(w):
            inner = "I" if scheme == "SBIE" else ("M1", "M2", "M")[min(i - 1, 2)]
            out.append((c, "B" if i == 0 else "E" if i == len(w) - 1 else inner))
    return out


def feature_tags(text: str, dictionaries: Sequence[frozenset[str]]) -> list[list[str]]:
    """For each character one tag for each dictionary: B, I, E of its longest words there, O outside."""
    columns = []
    for words in dictionaries:
        longest = max(map(len, words), default=1)
        tags, i = [], 0
        for w in longest_match(words, text, longest):
            inside = w in words and len(w) > 1
            tags += ["B", *["I"] * (len(w) - 2), "E"] if inside else ["O"] * len(w)
            i += len(w)
        columns.append(tags)
    return [list(x) for x in zip(*columns)]
