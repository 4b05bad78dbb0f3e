"""Rare characters between their two written forms: compositions in brackets and code points of the private use area.

Both directions join the tokens of a text to a dictionary, each distinct one once, and put the text together again from
its pieces; a token that the dictionary lacks stays. The dictionary may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COMPOSITION = r"\[[^\]]+\]"
PRIVATE = r"[\x{F0000}-\x{FFFFF}]"


def _replaced(df: DataFrame, key: str, column: str, dictionary: DataFrame, pattern: str, name: str) -> DataFrame:
    """dictionary: token, form. key: unique in df."""
    found = F.regexp_extract_all(F.col(column), F.lit(f"({pattern})"), F.lit(1))
    held = df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(found)).alias("token"))
    forms = dictionary.where("form is not null").groupBy("token").agg(F.min("form").alias("form"))
    known = held.join(forms, "token").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "form"))).alias("_forms"))
    tokens, pieces = F.col("_tokens"), F.col("_pieces")
    each = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(tokens)).alias("a"), tokens.alias("b")), lambda x: F.concat(x["a"], F.coalesce(F.try_element_at(F.col("_forms"), x["b"]), x["b"])))
    rows = df.join(known, df[key].eqNullSafe(known["_key"]), "left").withColumns({"_tokens": found, "_pieces": F.split(F.col(column), pattern, -1)})
    text: Column = F.when(F.col("_forms").isNull(), F.col(column)).otherwise(F.concat(F.array_join(each, ""), F.element_at(pieces, -1)))
    return rows.select(*[F.col(c) for c in df.columns if c != name], text.alias(name))


def to_private(df: DataFrame, key: str, column: str, glyphs: DataFrame, name: str | None = None) -> DataFrame:
    """Compositions by their characters; glyphs: composition, private."""
    return _replaced(df, key, column, glyphs.select(F.col("composition").alias("token"), F.col("private").alias("form")), COMPOSITION, name or column)


def to_composition(df: DataFrame, key: str, column: str, glyphs: DataFrame, name: str | None = None) -> DataFrame:
    """Characters of the private use area by their compositions."""
    return _replaced(df, key, column, glyphs.select(F.col("private").alias("token"), F.col("composition").alias("form")), PRIVATE, name or column)
