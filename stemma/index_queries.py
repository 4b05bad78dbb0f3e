"""Queries through a stored text index; their answers are those of the scans of the same names, and so is their SQL.

The index of a folder's documents is built once in a session, by the first query that needs it; `text_index` builds one
at each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .endpoint_queries import _places
from .operators import expand, kwic, phrase_index, search as S
from .plans.cut import new_folder
from .queries import DOCS, SQL, corpus, query, sql_hits

_BUILT: dict[tuple[str, str], phrase_index.TextIndex] = {}


def built(spark: SparkSession, sf: str) -> phrase_index.TextIndex:
    """Documents by language, as canons; the searchable form is the field, the text itself isn't kept."""
    return phrase_index.build(corpus(spark, sf).drop("text"), new_folder(spark, "index"), "doc_id", ["content"], "lang")


def index_of(spark: SparkSession, sf: str) -> phrase_index.TextIndex:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = built(spark, sf)
    return _BUILT[key]


@query(
    DOCS + ", p as (select lang, doc_id, unnest(range(1, length(c) + 1)) i, c from d), g as (select lang, doc_id, substr(c || chr(1114111), i, 2) pair from p) "
    "select lang, count(distinct doc_id) docs, count(distinct pair) pairs, count(*) n_places from g group by 1"
)
def text_index(spark, sf) -> DataFrame:
    """Counted by the stored blocks: a text's last character is paired with END, so that is one pair of each text."""
    rows = built(spark, sf).blocks().withColumnRenamed("canon", "lang")
    texts = rows.where(F.endswith("pair", F.lit(phrase_index.END))).select("lang", F.explode("keys").alias("key"))
    counted = texts.groupBy(F.col("lang").alias("_lang")).agg(F.countDistinct("key").alias("docs"))
    places = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    each = rows.groupBy("lang", "pair").agg(F.sum(places).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n_places"))
    return each.join(counted, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "docs", "pairs", "n_places")


@query(SQL["phrase_search"])
def indexed_phrase_search(spark, sf):
    index = index_of(spark, sf)
    return index.with_attributes(index.match('"of the"'), ["lang", "source"]).select("doc_id", "lang", "source", "term_hits")


@query(SQL["flagship"])
def indexed_flagship(spark, sf):
    """One canon: the folders of the others aren't read."""
    index = index_of(spark, sf)
    found = index.with_attributes(index.match('"of the"', canons=["en"]), ["n_chars"], ["en"]).select("doc_id", "term_hits", "n_chars")
    return S.page(S.order(found, "term_hits", ["doc_id"]), 0, 100)


@query(SQL["phrase_hits_total"])
def indexed_phrase_hits_total(spark, sf):
    return S.totals(index_of(spark, sf).match('"of the"'))


@query(SQL["bool_nested"])
def indexed_bool_nested(spark, sf):
    return index_of(spark, sf).match('"the" ("of a" | "to a") !"with a"').select("doc_id")


@query(DOCS + "select doc_id, cast(0 as bigint) term_hits from d where not contains(c, 'the')")
def indexed_bool_not(spark, sf):
    """Texts without any of the query's pairs match, too."""
    return index_of(spark, sf).match('!"the"')


@query(SQL["exclude_longer"])
def indexed_exclude_longer(spark, sf):
    return index_of(spark, sf).match('"of the" -"of their"')


@query(DOCS + f"select doc_id, {sql_hits('é')} + {sql_hits('ana')} term_hits from d where contains(c, 'é') or contains(c, 'ana')")
def indexed_single_and_overlapping(spark, sf):
    """A phrase of one character, and one that overlaps itself."""
    return index_of(spark, sf).match('"é" | "ana"')


@query(SQL["near_pairs"])
def indexed_near_pairs(spark, sf):
    return index_of(spark, sf).near(["of the", "in the"], [30]).select("doc_id", "p1", "p2")


NESTED_NEAR = (
    DOCS + ", p as (select doc_id, c, unnest(range(1, length(c)+1)) pos from d where contains(c,'in the')), "
    "a as (select doc_id, pos p1 from p where substr(c,pos,3)='the'), b as (select doc_id, pos p2 from p where substr(c,pos,6)='in the'), "
    # a tuple counts if the one that starts later ends behind the other
    "t as (select doc_id from a join b using (doc_id) where (p2 >= p1 and p2-p1-3 <= 7 and p2+6 > p1+3) or (p2 < p1 and p1-p2-6 <= 7 and p1+3 > p2+6)), "
    f"n as (select doc_id, count(*) n from t group by 1) select doc_id, n term_hits from n"
)


@query(NESTED_NEAR)
def near_of_nested_terms(spark, sf):
    """One term inside the other: tuples of which one term lies in the other one's place don't count."""
    return S.match(corpus(spark, sf), '"the" NEAR/7 "in the"', key="doc_id").select("doc_id", "term_hits")


@query(NESTED_NEAR)
def indexed_near_of_nested_terms(spark, sf):
    return index_of(spark, sf).match('"the" NEAR/7 "in the"')


@query(SQL["kwic_forward"])
def indexed_kwic_forward(spark, sf):
    found = index_of(spark, sf).occurrences("to be", 20)
    return S.page(kwic.concordance(found, "f", ["doc_id"]), 0, 30).select("doc_id", "pos", "right")


@query(SQL["all_in_one"])
def indexed_all_in_one(spark, sf):
    found = index_of(spark, sf).all_in_one('"to be"', order="term_hits", start=5, rows=10, around=12)
    return found.results.select("doc_id", "term_hits", _places(), F.get("kwics", F.lit(0))["left"].alias("first_left"))


@query(SQL["all_in_one_near"])
def indexed_all_in_one_near(spark, sf):
    found = index_of(spark, sf).all_in_one('"of the" NEAR/20 "in the"', start=5, rows=15)
    return found.results.select("doc_id", "term_hits", _places())


@query(SQL["near_facets"])
def indexed_near_facets(spark, sf):
    return index_of(spark, sf).all_in_one('"of the" NEAR/20 "in the"', facets=["lang", "source"]).facets


@query(SQL["variant_hits"])
def indexed_variant_hits(spark, sf):
    spellings = [r.spelling for r in expand.expansions(spark, "the", {"t": "d", "e": "a,é"}).collect()]  # the product of one query
    return index_of(spark, sf).spelling_hits(spellings)
