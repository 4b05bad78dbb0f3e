"""Keyword in context: positions, contexts, exclusion, proximity, collocation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import bound, running
from ..functions.text import quoted


def positions(text: Column, q: str) -> Column:
    """Places of q in text from 1 on, with overlapping ones."""
    parts = F.split(F.concat(F.lit("\x01"), text), f"(?={quoted(q)})", -1)
    ahead = lambda at, x: (at + F.length(x), F.array(at + F.length(x)))
    return bound(parts, lambda x: running(F.slice(x, 1, F.size(x) - 1), F.lit(0), ahead, "array<int>"))


def occurrences(docs: DataFrame, key: str, content: str, keywords: str | Sequence[str], around: int = 20) -> DataFrame:
    """key, keyword, pos, left, right: one row for each place of each keyword ('a,b' is two of them).

    The contexts of `around` characters are taken before the places are exploded, so no row carries its whole text. They
    are cut from blocks of the text, as a place in a long text is found by counting from its start.
    """
    words = keywords.split(",") if isinstance(keywords, str) else list(keywords)
    text = F.col(content)
    held = docs.where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))
    of_text = lambda c: with_contexts(c, {w: positions(c, w) for w in words}, around)
    return held.select(key, F.explode_outer(bound(text, of_text)).alias("o")).where(F.col("o").isNotNull()).select(key, "o.*")


def with_contexts(text: Column, places: Mapping[str, Column], around: int) -> Column:
    """keyword, pos, left, right of each place of each keyword, as one array."""
    size = max(256, 2 * around + max(map(len, places), default=0))

    def of(word: str, at_places: Column, blocks: Column) -> Column:
        def place(p: Column) -> Column:
            start = F.greatest(F.lit(1), p - around)
            at = F.floor((start - 1) / size).cast("int")
            near = F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit("")))
            return bound(near, lambda s: F.struct(
                F.lit(word).alias("keyword"), p.alias("pos"),
                F.substring(s, start - at * size, p - start).alias("left"), F.substring(s, p + len(word) - at * size, F.lit(around)).alias("right"),
            ))

        return F.transform(at_places, place)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda blocks: F.flatten(F.array(*[of(w, p, blocks) for w, p in places.items()])))


def concordance(found: DataFrame, sort: str, tie: Sequence[str]) -> DataFrame:
    """'f' by what follows, 'b' by what goes before (read backwards), 'location' by place."""
    keys = {"f": [F.col("right")], "b": [F.reverse(F.col("left"))], "location": []}[sort]
    return found.orderBy(*keys, *tie, "pos")


def marked() -> Column:
    return F.concat("left", F.lit("<mark>"), "keyword", F.lit("</mark>"), "right")


def with_punctuation(text: Column, offsets: Column, pos: Column, size: Column, around: int) -> Column:
    """Context of a hit in the text with punctuation, by the map from kept characters to all characters."""
    first, last = F.get(offsets, pos - 1), F.get(offsets, pos + size - 2)
    start = F.greatest(F.lit(0), first - around)
    return F.concat(
        F.substring(text, start + 1, first - start), F.lit("<mark>"), F.substring(text, first + 1, last - first + 1), F.lit("</mark>"), F.substring(text, last + 2, F.lit(around))
    )


def excluding(found: DataFrame, before: str = "", after: str = "") -> DataFrame:
    """Drops places where the keyword stands behind `before` or in front of `after` (alternatives by commas).

    The contexts must be as long as the longest alternative.
    """
    for part in filter(None, before.split(",")):
        found = found.where(~F.endswith("left", F.lit(part)))
    for part in filter(None, after.split(",")):
        found = found.where(~F.startswith("right", F.lit(part)))
    return found


def collocation(found: DataFrame, n: int, side: str = "after") -> DataFrame:
    """near, count: the n characters behind or before the keyword, by falling count."""
    near = F.substring("right", 1, n) if side == "after" else F.right("left", F.lit(n))
    return found.select(near.alias("near")).where(F.length("near") > 0).groupBy("near").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "near")


def near(docs: DataFrame, key: str, content: str, terms: Sequence[str], gaps: Sequence[int]) -> DataFrame:
    """key, p1, p2, …: places of terms of which each lies at most its gap from the one before it, in either order.

    A band join within the document, over buckets of the band's width, so that Spark joins by equality.
    """
    text = F.col(content)
    held = docs.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))
    return chain(lambda t, name: held.select(key, F.explode_outer(positions(text, t)).alias(name)).where(F.col(name).isNotNull()), key, terms, gaps)


def chain(places: Callable[[str, str], DataFrame], key: str, terms: Sequence[str], gaps: Sequence[int]) -> DataFrame:
    """near() of the places (key, and a column of the given name) that a function gives of each term."""
    out = places(terms[0], "p1")
    for i, (one, two, gap) in enumerate(zip(terms, terms[1:], gaps), start=1):
        a, b = F.col(f"p{i}"), F.col(f"p{i + 1}")
        width = gap + max(len(one), len(two))
        own = lambda at: F.floor(at / width)  # noqa: B023, E731
        around = lambda at: F.explode(F.array(*[own(at) + d for d in (-1, 0, 1)]))  # noqa: B023, E731
        few = len(two) > len(one)  # the longer term is the rarer one: its places go to three buckets
        left = out.withColumn("_bucket", own(a) if few else around(a))
        right = places(two, f"p{i + 1}").withColumn("_bucket", around(b) if few else own(b))
        apart = F.when(b >= a, b - a - len(one)).otherwise(a - b - len(two))
        out = left.join(right, [key, "_bucket"]).where((apart <= gap) & (a != b if one == two else F.lit(True))).drop("_bucket")
    return out


def drop_contained(pairs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Tuples of which, in the order of the text, some term lies outside the first one's span."""
    spans = F.array_sort(F.array(*[F.struct(F.col(f"p{i}").alias("p"), (F.col(f"p{i}") + len(t)).alias("e")) for i, t in enumerate(terms, start=1)]))
    return pairs.where(F.exists(spans, lambda s: s["e"] > F.get(spans, F.lit(0))["e"]))


def render_near(text: Column, places: Sequence[tuple[Column, int]]) -> Column:
    """Text from the first to the last term of a tuple, each term marked; what lies in an earlier span is skipped."""
    spans = F.array_sort(F.array(*[F.struct(p.alias("p"), (p + n).alias("e")) for p, n in places]))
    return F.aggregate(
        spans,
        F.struct(F.get(spans, F.lit(0))["p"].alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["e"] <= acc["at"], acc).otherwise(
            F.struct(
                s["e"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"], F.greatest(F.lit(0), s["p"] - acc["at"])), F.lit("<mark>"), F.substring(text, F.greatest(s["p"], acc["at"]), s["e"] - F.greatest(s["p"], acc["at"])), F.lit("</mark>")).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
