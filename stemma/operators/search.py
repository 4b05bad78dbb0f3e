"""Search over documents: match, filters, order, page, projection, facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normal, normal_query
from ..plans import qlang
from . import kwic


def searchable(docs: DataFrame, text: str = "text", name: str = "content") -> DataFrame:
    return docs.withColumn(name, normal(F.col(text)))


def match(docs: DataFrame, query: str, content: str = "content", key: str | None = None, verify: bool = True) -> DataFrame:
    """Rows that match, with term_hits. With NEAR a unique key is needed: its tuples are found by
    kwic.near(), and those of which all terms lie inside the first one don't count.

    Without verify texts that hold all terms of a NEAR chain are taken, for a caller that finds its tuples anyway.
    The searched text is bound once in each row; a filter of its own would be pushed down with a copy of the text's
    computation for every phrase.
    """
    tree = qlang.parse(query)
    nears = qlang.near_parts(tree)
    if nears and key is None:
        raise qlang.QueryError("NEAR needs a key")
    test = lambda c: F.struct(qlang.hit_count(tree, c).alias("hits"), qlang.predicate(tree, c).alias("ok"))
    judged = docs.withColumn("_m", F.explode_outer(F.filter(F.transform(F.array(content), test), lambda x: x["ok"])))
    rows = judged.where(F.col("_m").isNotNull()).select(*docs.columns, F.col("_m.hits").alias("term_hits"))
    for n in nears if verify else []:
        tuples = kwic.drop_contained(kwic.near(rows.select(key, content), key, content, n.terms, n.gaps), n.terms)
        found = tuples.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_tuples"))
        rows = rows.join(found, F.col(key) == F.col("_key")).withColumn("term_hits", F.col("term_hits") + F.col("_tuples")).drop("_key", "_tuples")
    return rows


def bag(docs: DataFrame, query: str, content: str = "content") -> DataFrame:
    """Rows with all words of the query in any order."""
    words = normal_query(query).split()
    return docs.where(reduce(lambda a, b: a & b, [F.contains(F.col(content), F.lit(w)) for w in words]))


def one_of(column: str, values: str | Sequence[str]) -> Column:
    """Equality or IN; a string is a list parted by commas, repeats don't matter."""
    wanted = list(dict.fromkeys(values.split(",") if isinstance(values, str) else values))
    return F.col(column) == wanted[0] if len(wanted) == 1 else F.col(column).isin(wanted)


def denied(column: str, values: Sequence[str]) -> Column:
    return ~F.col(column).isin(*values)


def cnf(column: str, spec: str, kind: str = "string") -> Column:
    """'a,b+c' over an array column: (a or b) and c."""
    clauses = [F.arrays_overlap(F.col(column), F.array(*[F.lit(v).cast(kind) for v in dict.fromkeys(c.split(","))])) for c in spec.split("+")]
    return reduce(lambda a, b: a & b, clauses)


def overlaps(start: str, stop: str, low, high) -> Column:
    return (F.col(start) <= F.lit(high)) & (F.col(stop) >= F.lit(low))


def endpoint_inside(start: str, stop: str, low, high) -> Column:
    """An interval that encloses the range on both sides is not taken (mode 'endpoint' of the works finder)."""
    return F.col(start).between(F.lit(low), F.lit(high)) | F.col(stop).between(F.lit(low), F.lit(high))


def like(column: str, part: str) -> Column:
    """Contains part literally."""
    return F.contains(F.col(column), F.lit(part))


def order(df: DataFrame, spec: str, tie: Sequence[str], years: Sequence[str] = ()) -> DataFrame:
    """'field', 'field+', 'field-' parted by commas; term_hits is descending by default; unknown years (0) come last."""
    keys = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, sign = (part[:-1], part[-1]) if part[-1] in "+-" else (part, "-" if part == "term_hits" else "+")
        if name in years:
            keys.append(F.desc(F.coalesce(F.col(name), F.lit(0)) != 0))
        keys.append(F.col(name).desc() if sign == "-" else F.col(name).asc())
    return df.orderBy(*keys, *tie)


def page(df: DataFrame, start: int = 0, rows: int = 20) -> DataFrame:
    if start < 0 or rows < 0:
        raise qlang.QueryError("start and rows must not be negative")
    return df.offset(start).limit(rows)


def project(df: DataFrame, fields: str, known: Mapping[str, str]) -> DataFrame:
    """The known ones of the fields asked for, under their output names."""
    wanted = [f for f in dict.fromkeys(fields.split(",")) if f in known] or list(known)
    return df.select(*[F.col(known[f]).alias(f) for f in wanted])


def totals(matched: DataFrame) -> DataFrame:
    """num_found, total_term_hits: one row."""
    return matched.agg(F.count(F.lit(1)).alias("num_found"), F.coalesce(F.sum("term_hits"), F.lit(0)).alias("total_term_hits"))


def exists(docs: DataFrame, query: str, content: str = "content") -> bool:
    return not match(docs, query, content).limit(1).isEmpty()


def facet(matched: DataFrame, key: str, multi: bool = False, limit: int = 10_000) -> DataFrame:
    """value, docs, hits by falling hits; an array column counts once for each element."""
    rows = matched.select(F.explode(key).alias("value"), "term_hits") if multi else matched.select(F.col(key).alias("value"), "term_hits")
    counted = rows.groupBy("value").agg(F.count(F.lit(1)).alias("docs"), F.sum("term_hits").alias("hits"))
    return counted.orderBy(F.desc("hits"), "value").limit(limit)


def facet_bundle(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """facet, value, docs, hits of several facets in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in keys])
    rows = matched.select(F.explode(pairs).alias("f"), "term_hits").select("f.*", "term_hits")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("docs"), F.sum("term_hits").alias("hits"))


def named(facets: DataFrame, names: DataFrame, key: str, name: str, order_by: str | None = None, last: int = 999) -> DataFrame:
    """Facets with names; with order_by, in that order and unknown values last."""
    joined = facets.join(names, facets["value"] == names[key], "left")
    if order_by is None:
        return joined.select(facets["*"], names[name].alias("name"))
    rank = F.coalesce(names[order_by], F.lit(last))
    return joined.select(facets["*"], names[name].alias("name"), rank.alias("rank")).orderBy("rank", "value")


def grouped(rows: DataFrame, by: str, fields: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row for each group with its rows as an ordered array of structs."""
    item = F.struct(*order_by, *[f for f in fields if f not in order_by])
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("term_hits").alias("term_hits"))


def envelope(found: DataFrame, total: DataFrame) -> DataFrame:
    """The answer as one JSON text: counts and results. Results are a page, so they may meet in one row."""
    results = found.agg(F.collect_list(F.struct(*found.columns)).alias("results"))
    return total.join(F.broadcast(results)).select(F.to_json(F.struct("num_found", "total_term_hits", "results")).alias("json"))
