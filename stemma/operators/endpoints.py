"""Searches composed of the operators: what one request of a search service answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mark_chars, mark_phrase, note_inline
from ..plans import qlang
from ..plans.cut import cut
from . import expand, kwic, search


def concordance(docs: DataFrame, key: str, content: str, query: str, around: int = 20) -> DataFrame:
    """key, keyword, pos, left, mark, right: the places that count for a query.

    'a,b' without quotes is a list of keywords. An exclusion drops the places inside the longer phrase. A NEAR chain
    gives a row for each tuple of places, from its first term to its last, less tuples inside one term.
    """
    if '"' not in query and "," in query:
        found = kwic.occurrences(docs, key, content, list(dict.fromkeys(query.split(","))), around)
        return _marked(found, key)
    tree = qlang.parse(query)
    parts = tree.parts if isinstance(tree, (qlang.And, qlang.Or)) else (tree,)
    out = None
    plain: list[str] = []
    for part in parts:
        rows = None
        if isinstance(part, qlang.Near):
            rows = _chain(docs, key, content, part, around)
        elif isinstance(part, qlang.Exclude):
            at = part.longer.index(part.phrase)
            before, after = part.longer[:at], part.longer[at + len(part.phrase) :]
            found = kwic.occurrences(docs, key, content, [part.phrase], max(around, len(part.longer)))
            found = found.where(~(F.endswith("left", F.lit(before)) & F.startswith("right", F.lit(after))))
            rows = _marked(found.withColumns({"left": F.right("left", F.lit(around)), "right": F.left("right", F.lit(around))}), key)
        else:
            plain += qlang.phrases(part)
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    if plain:
        rows = _marked(kwic.occurrences(docs, key, content, list(dict.fromkeys(plain)), around), key)
        out = rows if out is None else out.unionByName(rows)
    return out


def _marked(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "keyword", "pos", "left", F.concat(F.lit("<mark>"), "keyword", F.lit("</mark>")).alias("mark"), "right")


def _chain(docs: DataFrame, key: str, content: str, chain: qlang.Near, around: int) -> DataFrame:
    tuples = kwic.drop_contained(kwic.near(docs.select(key, content), key, content, chain.terms, chain.gaps), chain.terms)
    places = [f"p{i}" for i in range(1, len(chain.terms) + 1)]
    lists = tuples.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*places)).alias("_t"))  # of one text
    text = F.col(content)

    def shown(t: Column) -> Column:
        first = F.least(*[t[p] for p in places])
        last = F.greatest(*[t[p] + len(term) for p, term in zip(places, chain.terms)])
        start = F.greatest(F.lit(1), first - around)
        return F.struct(
            first.alias("pos"), F.substring(text, start, first - start).alias("left"),
            kwic.render_near(text, [(t[p], len(term)) for p, term in zip(places, chain.terms)]).alias("mark"), F.substring(text, last, F.lit(around)).alias("right"),
        )

    rows = docs.join(lists, docs[key] == lists["_key"]).select(key, F.explode_outer(F.transform("_t", shown)).alias("x"))
    name = "".join(f"{t} NEAR/{g} " for t, g in zip(chain.terms, chain.gaps)) + chain.terms[-1]
    return rows.select(key, F.lit(name).alias("keyword"), "x.*")


@dataclass
class Answer:
    results: DataFrame
    total: DataFrame
    facets: DataFrame | None


def all_in_one(
    docs: DataFrame, key: str, content: str, query: str, order: str = "", tie: Sequence[str] = (), start: int = 0, rows: int = 20, around: int = 20, facets: Sequence[str] = ()
) -> Answer:
    """Hits with their places as kwics (array of structs by pos), the totals, and facets on demand.

    Where the search alone can't tell the hits, for NEAR and exclusion, all places are found first: their number is
    term_hits, texts without a place go, and what is left is written, for the page, the totals and the facets. Else only
    the page's places are found.
    """
    tree = qlang.parse(query)
    parts = tree.parts if isinstance(tree, qlang.And) else (tree,)
    found = search.match(docs, query, content, key, verify=not isinstance(tree, qlang.Near))  # the places of one chain say it all

    def with_places(matched: DataFrame) -> DataFrame:
        places = concordance(matched, key, content, query, around)
        lists = places.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("pos", "keyword", "left", "mark", "right"))).alias("kwics"))
        return matched.join(lists, matched[key] == lists["_key"]).drop("_key")

    page = lambda df: search.page(search.order(df, order, [*tie, key]), start, rows)
    if any(isinstance(p, (qlang.Near, qlang.Exclude)) for p in parts):
        found = with_places(found).withColumn("term_hits", F.size("kwics").cast("long"))
        found = cut(found)  # page, totals and facets are made from what is found once
        results = page(found)
    else:
        results = search.order(with_places(page(found)), order, [*tie, key])
    return Answer(results, search.totals(found), search.facet_bundle(found, facets) if facets else None)


def notes(docs: DataFrame, note: str, content: str, query: str, prefix: str | None = None, suffix: str | None = None, around: int = 30) -> DataFrame:
    """Notes that match, with term_hits and the note's highlight; inline notes (with a prefix) between what stands around them."""
    found = search.match(docs, query, content)
    marked = F.col(note)
    for q in dict.fromkeys(qlang.phrases(qlang.parse(query))):
        marked = mark_phrase(marked, q)
    if prefix:
        marked = F.when(F.col(prefix).isNotNull(), note_inline(F.col(prefix), marked, F.col(suffix), around)).otherwise(marked)
    return found.withColumn("highlight", marked)


def titles(titled: DataFrame, content: str, query: str, works: DataFrame, key: str, take: Sequence[str], least: int = 3) -> DataFrame:
    """Titles with at least `least` of the query's characters (all of a shorter query), marked, with their work's columns."""
    chars = list(dict.fromkeys(query.replace(" ", "")))
    held = sum((F.contains(F.col(content), F.lit(c)).cast("int") for c in chars), F.lit(0))
    found = titled.where(held >= min(least, len(chars))).withColumn("highlight", mark_chars(F.col(content), query.replace(" ", "")))
    return found.join(works.select(F.col(key).alias("_key"), *take), found[key] == F.col("_key")).drop("_key")


def document(texts: DataFrame, toc: DataFrame | None = None, works: DataFrame | None = None, **wanted) -> DataFrame:
    """The one text with the wanted keys; with its table of contents (work, toc) and its work's record where asked for."""
    found = texts.where(equal_to(wanted, {k: k for k in texts.columns}))
    if toc is not None:
        found = found.join(toc.select(F.col("work").alias("_work"), "toc"), found["work"] == F.col("_work"), "left").drop("_work")
    if works is not None:
        record = works.select(F.col("work").alias("_work"), F.struct(*[c for c in works.columns if c != "work"]).alias("work_info"))
        found = found.join(record, found["work"] == F.col("_work"), "left").drop("_work")
    return found


def equal_to(given: Mapping[str, object], permitted: Mapping[str, str], needs: Mapping[str, str] | None = None) -> Column:
    """Equality on the permitted keys that are given; a key may need another one beside it."""
    for k, other in (needs or {}).items():
        if given.get(k) is not None and given.get(other) is None:
            raise qlang.QueryError(f"{k} needs {other}")
    out = F.lit(True)
    for k, column in permitted.items():
        if given.get(k) is not None:
            out = out & (F.col(column) == F.lit(given[k]))
    return out


def one_for_each_line(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """One of the places on each line, the last one; by line."""
    last = found.groupBy(*by).agg(F.max_by(F.struct(*[c for c in found.columns if c not in by]), F.struct("pos", "keyword")).alias("x"))
    return last.select(*by, "x.*").orderBy(*by)


def in_canon_order(rows: DataFrame, canons: DataFrame, canon: str, key: str, rest: Sequence[str]) -> DataFrame:
    """Rows by their canon's sort key (its own name where the table has none), then by the rest."""
    known = canons.select(F.col(canon).alias("_canon"), F.col(key).alias("_key"))
    return rows.join(known, rows[canon] == F.col("_canon"), "left").withColumn("canon_order", F.coalesce("_key", canon)).drop("_canon", "_key").orderBy("canon_order", *rest)


def collections(canons: DataFrame, works: DataFrame, canon: str) -> DataFrame:
    """Canons with the number of their works."""
    counted = works.groupBy(F.col(canon).alias("_canon")).agg(F.count(F.lit(1)).alias("works"))
    return canons.join(counted, canons[canon] == F.col("_canon"), "left").drop("_canon").na.fill({"works": 0})


def simplified(docs: DataFrame, content: str, query: str, forms: Mapping[str, str], most: int = 50) -> DataFrame:
    """num_found and total_term_hits of a query in the other script; 0 where the conversion changes nothing."""
    if len(query) > most:
        raise qlang.QueryError(f"the query has over {most} characters")
    words = expand.longest_match(frozenset(forms), query, max(map(len, forms), default=1))
    other = "".join(forms.get(w, w) for w in words)
    return search.totals(search.match(docs.where(F.lit(other != query)), f'"{other}"', content))


class ResultCache:
    """Answers by release, parameters and kind of caller, for a session; an answer is kept as a persisted DataFrame."""

    def __init__(self, release: str, most: int = 100):
        self.release, self.most, self.held = release, most, {}

    def fetch(self, parameters: Mapping[str, object], caller: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.release, tuple(sorted((k, str(v)) for k, v in parameters.items())), caller)
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).unpersist()
            self.held[key] = make().persist()
        return self.held[key]


def allowed(rows: DataFrame, key: str, blocked: Sequence[object]) -> DataFrame:
    """An export less the blocked keys."""
    return rows.where(~F.col(key).isin(list(blocked)) | F.col(key).isNull()) if blocked else rows
