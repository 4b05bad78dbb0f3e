"""The reference's operators over the driver's tables, each beside the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import text as T
from .operators import catalog, expand, kwic, relations as R, search as S, similar, stats, versions
from .sources.markup import html_text
from .streaming.visits import daily_counts as daily

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
#: The searchable form in SQL, as functions.text.normal().
NORM = "translate(lower(text), '" + T.ignored().replace("'", "''") + "', '')"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{NORM}", NORM)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return S.searchable(table(spark, sf, "documents"))


def sql_hits(q: str, t: str = "c") -> str:
    return f"cast((length({t}) - length(replace({t}, '{q}', ''))) / {len(q)} as bigint)"


DOCS = "with d as (select *, {NORM} c from documents) "


# Search.


@query(DOCS + f"select doc_id, lang, source, {sql_hits('of the')} term_hits from d where contains(c, 'of the')")
def phrase_search(spark, sf):
    return S.match(corpus(spark, sf), '"of the"').select("doc_id", "lang", "source", "term_hits")


@query(DOCS + f"select count(*) num_found, cast(coalesce(sum({sql_hits('of the')}), 0) as bigint) total_term_hits from d where contains(c, 'of the')")
def phrase_hits_total(spark, sf):
    return S.totals(S.match(corpus(spark, sf), '"of the"'))


@query(DOCS + f"select doc_id, {sql_hits('of the')} term_hits from d where contains(c, 'of the') order by term_hits desc, doc_id limit 20 offset 20")
def page_slice(spark, sf):
    found = S.match(corpus(spark, sf), '"of the"').select("doc_id", "term_hits")
    return S.page(S.order(found, "term_hits", ["doc_id"]), 20, 20)


@query(DOCS + f"select doc_id, {sql_hits('of the')} + {sql_hits('in the')} term_hits from d where contains(c, 'of the') and contains(c, 'in the')")
def bool_and(spark, sf):
    return S.match(corpus(spark, sf), '"of the" "in the"').select("doc_id", "term_hits")


@query(DOCS + f"select doc_id, {sql_hits('to be')} + {sql_hits('in the')} term_hits from d where contains(c, 'to be') or contains(c, 'in the')")
def bool_or(spark, sf):
    return S.match(corpus(spark, sf), '"to be" | "in the"').select("doc_id", "term_hits")


@query(DOCS + f"select doc_id, {sql_hits('of the')} term_hits from d where contains(c, 'of the') and not contains(c, 'in the')")
def bool_not(spark, sf):
    return S.match(corpus(spark, sf), '"of the" !"in the"').select("doc_id", "term_hits")


@query(DOCS + "select doc_id from d where contains(c, 'the') and (contains(c, 'of a') or contains(c, 'to a')) and not contains(c, 'with a')")
def bool_nested(spark, sf):
    return S.match(corpus(spark, sf), '"the" ("of a" | "to a") !"with a"').select("doc_id")


@query(DOCS + f"select doc_id, {sql_hits('of the')} - {sql_hits('of their')} term_hits from d where {sql_hits('of the')} > {sql_hits('of their')}")
def exclude_longer(spark, sf):
    return S.match(corpus(spark, sf), '"of the" -"of their"').select("doc_id", "term_hits")


@query(
    "with q as (select item_id, translate(lower(text), '" + T.ignored().replace("'", "''") + "', '') c from benchmark) select item_id from q "
    "where cast(contains(c,'the') as int) + cast(contains(c,'and') as int) + cast(contains(c,'de') as int) + cast(contains(c,'ing') as int) >= 3"
)
def quorum_count(spark, sf):
    return S.match(S.searchable(table(spark, sf, "benchmark")), '"the and de ing"/3').select("item_id")


@query("select p_partkey from part where cast(contains(lower(p_name),'a') as int)+cast(contains(lower(p_name),'b') as int)+cast(contains(lower(p_name),'c') as int)+cast(contains(lower(p_name),'d') as int)>=2")
def quorum_fraction(spark, sf):
    return S.match(S.searchable(table(spark, sf, "part"), "p_name"), '"abcd"/0.5').select("p_partkey")


@query(DOCS + "select doc_id from d where contains(c,'thea') and contains(c,'of') and contains(c,'with')")
def bag_match(spark, sf):
    return S.bag(corpus(spark, sf), "with thea of").select("doc_id")


@query(DOCS + f"select doc_id id, {sql_hits('in the')} hits, n_chars from d where contains(c, 'in the')")
def projection_whitelist(spark, sf):
    found = S.match(corpus(spark, sf), '"in the"')
    return S.project(found, "id,unknown,hits,n_chars", {"id": "doc_id", "hits": "term_hits", "n_chars": "n_chars", "lang": "lang"})


@query("select doc_id from documents where lang in ('en','fr') and source not in ('src1','src2')")
def filters_in_deny(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(S.one_of("lang", "en,fr,en") & S.denied("source", ["src1", "src2"])).select("doc_id")


@query(
    "with w as (select p_partkey, string_split(lower(p_name), ' ') ws from part) select p_partkey from w "
    "where (list_contains(ws,'almond') or list_contains(ws,'red') or list_contains(ws,'blue')) and (list_contains(ws,'green') or list_contains(ws,'bolt') or list_contains(ws,'steel'))"
)
def cnf_multivalue(spark, sf):
    words = table(spark, sf, "part").withColumn("ws", F.split(F.lower("p_name"), " "))
    return words.where(S.cnf("ws", "almond,red,blue+green,bolt,steel")).select("p_partkey")


@query(
    "with s as (select l_suppkey, min(l_shipdate) a, max(l_shipdate) b from lineitem where l_quantity > 45 group by 1) select l_suppkey from s "
    "where a <= timestamp '1995-01-31' and b >= timestamp '1995-01-10'"
)
def interval_overlap(spark, sf):
    return _ship_spans(spark, sf).where(S.overlaps("a", "b", "1995-01-10", "1995-01-31")).select("l_suppkey")


@query(
    "with s as (select l_suppkey, min(l_shipdate) a, max(l_shipdate) b from lineitem where l_quantity > 45 group by 1) select l_suppkey from s "
    "where a between timestamp '1995-01-10' and timestamp '1995-02-10' or b between timestamp '1995-01-10' and timestamp '1995-02-10'"
)
def endpoint_in_range(spark, sf):
    return _ship_spans(spark, sf).where(S.endpoint_inside("a", "b", "1995-01-10", "1995-02-10")).select("l_suppkey")


def _ship_spans(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))


@query("select p_partkey from part where contains(p_name, 'a') and not contains(p_name, 'e')")
def like_and_not_like(spark, sf):
    return table(spark, sf, "part").where(S.like("p_name", "a") & ~S.like("p_name", "e")).select("p_partkey")


@query("select c_custkey from customer where c_name between 'Customer#000000010' and 'Customer#000000099' or starts_with(c_mktsegment, 'AUTO')")
def prefix_and_range(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").between("Customer#000000010", "Customer#000000099") | F.startswith("c_mktsegment", F.lit("AUTO"))).select("c_custkey")


@query("select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null and d.text is not null")
def null_filters(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").where("quality is null and text is not null").select("doc_id")


@query("select o_orderkey from orders order by (case when o_orderstatus = 'F' then 0 else 1 end) desc, o_totalprice, o_orderkey limit 50")
def order_known_first(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1))
    known = S.order(orders, "year-,o_totalprice", ["o_orderkey"], years=["year"])
    return S.page(known, 0, 50).select("o_orderkey")


# Facets.


@query(DOCS + f"select lang as value, count(*) docs, cast(sum({sql_hits('in the')}) as bigint) hits from d where contains(c,'in the') group by 1")
def facet_lang(spark, sf):
    return S.facet(S.match(corpus(spark, sf), '"in the"'), "lang")


@query(
    DOCS + f"select * from (select 'lang' facet, lang as value, count(*) docs, cast(sum({sql_hits('the')}) as bigint) hits from d where contains(c,'the') group by 2 "
    f"union all select 'source', source, count(*), cast(sum({sql_hits('the')}) as bigint) from d where contains(c,'the') group by 2)"
)
def facet_bundle(spark, sf):
    return S.facet_bundle(S.match(corpus(spark, sf), '"the"'), ["lang", "source"])


@query("select w as value, count(*) docs, count(*) hits from (select unnest(string_split(p_name, ' ')) w from part) group by 1")
def facet_multivalue(spark, sf):
    words = table(spark, sf, "part").select(F.split("p_name", " ").alias("w"), F.lit(1).cast("long").alias("term_hits"))
    return S.facet(words, "w", multi=True)


@query("select n_name as name, f.n_nationkey as value, docs from (select c_nationkey n_nationkey, count(*) docs from customer group by 1) f join nation using (n_nationkey)")
def facet_names(spark, sf):
    customers = table(spark, sf, "customer").withColumn("term_hits", F.lit(1))
    return S.named(S.facet(customers, "c_nationkey"), table(spark, sf, "nation"), "n_nationkey", "n_name").select("name", "value", "docs")


@query(DOCS + f"select source, count(*) n, cast(sum({sql_hits('to be')}) as bigint) term_hits from d where contains(c,'to be') group by 1")
def group_by_work(spark, sf):
    found = S.match(corpus(spark, sf), '"to be"')
    return S.grouped(found, "source", ["term_hits"], ["doc_id"]).select("source", F.size("items").cast("long").alias("n"), "term_hits")


# Concordance.

OVERLAPPING = DOCS + ", p as (select doc_id, c, unnest(range(1, length(c) + 1)) pos from d where contains(c, '{q}')), h as (select doc_id, c, pos from p where substr(c, pos, {n}) = '{q}') "


def places(q: str) -> str:
    return OVERLAPPING.replace("{q}", q).replace("{n}", str(len(q)))


@query(places("to be") + "select doc_id, cast(pos as int) pos, substr(c, greatest(1, pos-10), pos - greatest(1, pos-10)) as \"left\", substr(c, pos+5, 10) as \"right\" from h")
def kwic_location(spark, sf):
    found = kwic.occurrences(corpus(spark, sf), "doc_id", "content", "to be", 10)
    return kwic.concordance(found, "location", ["doc_id"]).select("doc_id", "pos", "left", "right")


@query(places("to be") + "select doc_id, cast(pos as int) pos, substr(c, pos+5, 20) as \"right\" from h order by substr(c, pos+5, 20), doc_id, pos limit 30")
def kwic_forward(spark, sf):
    found = kwic.occurrences(corpus(spark, sf), "doc_id", "content", "to be", 20)
    return S.page(kwic.concordance(found, "f", ["doc_id"]), 0, 30).select("doc_id", "pos", "right")


@query(
    places("to be") + ", k as (select doc_id, pos, substr(c, greatest(1, pos-20), pos - greatest(1, pos-20)) l from h) "
    'select doc_id, cast(pos as int) pos, l as "left" from k order by reverse(l), doc_id, pos limit 30'
)
def kwic_backward(spark, sf):
    found = kwic.occurrences(corpus(spark, sf), "doc_id", "content", "to be", 20)
    return S.page(kwic.concordance(found, "b", ["doc_id"]), 0, 30).select("doc_id", "pos", "left")


@query(places("erer") + "select doc_id, count(*) n from h group by 1")
def kwic_overlapping(spark, sf):
    return kwic.occurrences(corpus(spark, sf), "doc_id", "content", "erer").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    DOCS + ", p as (select doc_id, c, unnest(range(1, length(c)+1)) pos from d where contains(c,'to be') or contains(c,'is and')), "
    "h as (select doc_id, pos, 'to be' keyword from p where substr(c,pos,5)='to be' union all select doc_id, pos, 'is and' from p where substr(c,pos,6)='is and') "
    "select doc_id, keyword, cast(pos as int) pos from h"
)
def kwic_keywords(spark, sf):
    return kwic.occurrences(corpus(spark, sf), "doc_id", "content", "to be,is and").select("doc_id", "keyword", "pos")


@query(places("the") + "select doc_id, count(*) n from h where substr(c, pos+3, 1) <> 'r' and (pos = 1 or substr(c, pos-1, 1) <> 'o') group by 1")
def kwic_exclude(spark, sf):
    found = kwic.excluding(kwic.occurrences(corpus(spark, sf), "doc_id", "content", "the", 1), "o", "r")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(places("of the") + "select substr(c, pos+6, 3) near, count(*) as count from h where length(substr(c, pos+6, 3)) > 0 group by 1")
def collocation_next(spark, sf):
    return kwic.collocation(kwic.occurrences(corpus(spark, sf), "doc_id", "content", "of the", 3), 3)


@query(places("of the") + "select substr(c, greatest(1,pos-3), least(3,pos-1)) near, count(*) as count from h where pos > 1 group by 1")
def collocation_prev(spark, sf):
    return kwic.collocation(kwic.occurrences(corpus(spark, sf), "doc_id", "content", "of the", 3), 3, "before")


NEAR_SQL = (
    DOCS + ", p as (select doc_id, c, unnest(range(1, length(c)+1)) pos from d where contains(c,'of the') and contains(c,'in the')), "
    "a as (select doc_id, pos p1 from p where substr(c,pos,6)='of the'), b as (select doc_id, pos p2 from p where substr(c,pos,6)='in the') "
)


@query(NEAR_SQL + "select doc_id, cast(p1 as int) p1, cast(p2 as int) p2 from a join b using (doc_id) where (p2 >= p1 and p2-p1-6 <= 30) or (p2 < p1 and p1-p2-6 <= 30)")
def near_pairs(spark, sf):
    return kwic.near(corpus(spark, sf), "doc_id", "content", ["of the", "in the"], [30]).select("doc_id", "p1", "p2")


@query(
    NEAR_SQL.replace("contains(c,'in the')", "contains(c,'in the') and contains(c,'to')") + ", e as (select doc_id, pos p3 from p where substr(c,pos,2)='to') "
    "select doc_id, count(*) n from a join b using (doc_id) join e using (doc_id) where ((p2 >= p1 and p2-p1-6 <= 60) or (p2 < p1 and p1-p2-6 <= 60)) "
    "and ((p3 >= p2 and p3-p2-6 <= 15) or (p3 < p2 and p2-p3-2 <= 15)) group by 1"
)
def near_chain(spark, sf):
    found = kwic.near(corpus(spark, sf), "doc_id", "content", ["of the", "in the", "to"], [60, 15])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# Relations.


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def left_enrich(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    named = R.enrich(c, n, c.c_nationkey == n.n_nationkey, {"n_name": "n_name", "n_regionkey": "n_regionkey"})
    return R.enrich(named, r, named.n_regionkey == r.r_regionkey, {"r_name": "r_name"}).select("c_custkey", "n_name", "r_name")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def lookup_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return R.require(R.enrich(o, c, o.o_custkey == c.c_custkey, {"c_name": "c_name"}), "c_name").select("o_orderkey", "c_name")


@query("select n_nationkey, count(c_custkey) customers from nation left join customer on c_nationkey = n_nationkey group by 1")
def count_per_parent(spark, sf):
    return R.child_counts(table(spark, sf, "nation"), table(spark, sf, "customer"), "n_nationkey", "c_nationkey", "customers").select("n_nationkey", "customers")


@query(
    "select p_partkey, coalesce(string_agg(s_name, ',' order by s_name), '') suppliers from part left join "
    "(select distinct l_partkey, l_suppkey from lineitem) on l_partkey = p_partkey left join supplier on s_suppkey = l_suppkey group by 1"
)
def bridge_list(spark, sf):
    part, line, supp = (table(spark, sf, t) for t in ("part", "lineitem", "supplier"))
    out = R.bridged(part, line, supp, "p_partkey", "l_partkey", "l_suppkey", "s_suppkey", F.col("s_name"), "suppliers")
    return out.select("p_partkey", F.array_join("suppliers", ",").alias("suppliers"))


@query(
    "with c as (select event_id, user_id, ts from events where event_type = 'click'), p as (select user_id, ts, max(event_id) pid from events where event_type = 'view' group by 1, 2) "
    "select event_id, pid from c asof left join p on c.user_id = p.user_id and c.ts >= p.ts"
)
def asof_prior_event(spark, sf):
    events = table(spark, sf, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("pid"))
    return R.as_of(clicks, views, ["user_id"], "ts", "ts", ["pid"]).select("event_id", "pid")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last from orders group by 1")
def first_last_per_group(spark, sf):
    return R.ends(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey"))


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r from orders) where r = 1")
def first_row(spark, sf):
    return R.first_by(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) names from nation group by 1")
def group_to_list(spark, sf):
    return R.to_list(table(spark, sf, "nation"), ["n_regionkey"], F.col("n_name"), "names")


TREE_SQL = (
    "with recursive t as (select 'r' || r_regionkey id, null as parent, r_name as label from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation "
    "union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer), "
)


def _tree(spark, sf):
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    node = lambda df, id_, parent, label: df.select(id_.alias("id"), parent.alias("parent"), F.col(label).alias("label"))
    key = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    tops = node(r, key("r", "r_regionkey"), F.lit(None).cast("string"), "r_name")
    return tops.union(node(n, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(node(c, key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))


@query(TREE_SQL + "w as (select id, 0 as depth, label path from t where parent is null union all select t.id, w.depth + 1, w.path || '/' || t.label from w join t on t.parent = w.id) select id, depth, path from w")
def tree_path(spark, sf):
    return R.paths(_tree(spark, sf))


@query(TREE_SQL + "w as (select id, 0 as depth from t where id = 'r1' union all select t.id, w.depth + 1 from w join t on t.parent = w.id) select id, depth from w")
def tree_subtree(spark, sf):
    return R.subtree(_tree(spark, sf), "r1")


@query("select a.n_regionkey, a.n_name a, b.n_name b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name")
def sibling_pairs(spark, sf):
    return R.pairs_within(table(spark, sf, "nation"), "n_regionkey", "n_name")


@query("select a.n_name term, string_agg(distinct b.n_name, ',' order by b.n_name) synonyms from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name group by 1")
def synonym_groups(spark, sf):
    return expand.synonyms(table(spark, sf, "nation"), "n_regionkey", "n_name").select("term", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    "with recursive v as (select lower(substr(r_name, 1, 1)) k, lower(substr(r_name, 2, 1)) f from region), w as (select distinct lower(n_name) word from nation), "
    "s as (select word, 0 n, '' spelling from w union all select word, n + 1, spelling || x from s, lateral (select substr(word, n + 1, 1) x union select f from v where k = substr(word, n + 1, 1)) where n < length(word)) "
    "select distinct word, spelling from s where n = length(word)"
)
def variant_product(spark, sf):
    """Spellings of nation names; a region's second letter is a variant of its first."""
    words = table(spark, sf, "nation").select(F.lower("n_name").alias("w"))
    variants = table(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 1)).alias("k"), F.lower(F.substring("r_name", 2, 1)).alias("vars"))
    return expand.spellings(words, "w", variants)


@query(
    DOCS + f", v as (select 'the' spelling, sum({sql_hits('the')}) hits from d union all select 'tha', sum({sql_hits('tha')}) from d union all select 'thé', sum({sql_hits('thé')}) from d "
    f"union all select 'dhe', sum({sql_hits('dhe')}) from d union all select 'dha', sum({sql_hits('dha')}) from d union all select 'dhé', sum({sql_hits('dhé')}) from d) select spelling, cast(hits as bigint) hits from v where hits > 0"
)
def variant_hits(spark, sf):
    spellings = [r.spelling for r in expand.expansions(spark, "the", {"t": "d", "e": "a,é"}).collect()]  # the product of one query
    return expand.spelling_hits(corpus(spark, sf), "content", spellings)


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_missing(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return R.missing(d, l, d.doc_id == l.doc_id).select("doc_id")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def semi_existing(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 100000")
    return R.existing(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query("select conv_id, turn, lead(text) over (partition by conv_id order by turn) as next from conversations")
def neighbour_next(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lead("text").over(w).alias("next"))


@query("select conv_id, turn, role is distinct from lag(role) over w or row_number() over w = 1 as new_role from conversations window w as (partition by conv_id order by turn)")
def change_flags(spark, sf):
    return R.changed(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "new_role").select("conv_id", "turn", "new_role")


@query("select conv_id, turn, row_number() over (order by conv_id, turn) ser_no from conversations")
def serial_numbers(spark, sf):
    return R.serial(table(spark, sf, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "ser_no")


@query(
    "select conv_id, turn, coalesce(list_aggregate(list(role) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), 'string_agg', ','), '') as before, "
    "coalesce(list_aggregate(list(role) over (partition by conv_id order by turn rows between 1 following and 2 following), 'string_agg', ','), '') as after from conversations"
)
def serial_neighbours(spark, sf):
    out = R.neighbours(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", 2)
    return out.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(
    "select event_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_view from events"
)
def forward_fill(spark, sf):
    seen = F.when(F.col("event_type") == "view", F.col("event_id"))
    return R.fill_forward(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], seen, "last_view").select("event_id", "last_view")


@query("select n_nationkey, lpad(cast(row_number() over (partition by n_regionkey order by n_name) as varchar), 3, '0') sort from nation")
def sibling_sort_keys(spark, sf):
    return R.sort_keys(table(spark, sf, "nation"), "n_regionkey", ["n_name"]).select("n_nationkey", "sort")


@query(
    DOCS + ", n as (select doc_id, c, greatest(cast(ceil(length(c) / 50.0) as int) - 1, 1) n from d where length(c) > 0), r as (select doc_id, c, n, unnest(range(0, n)) k from n) "
    "select doc_id, cast(k as int) chunk, case when k = n - 1 then 'end' when k = 0 then 'start' else 'middle' end tag, substr(c, k * 50 + 1, 100) as content from r"
)
def chunks_overlap(spark, sf):
    return similar.chunks(corpus(spark, sf), "doc_id", "content")


@query("select 'supplier' as type, s_name as name, s_nationkey nation from supplier union all select 'customer', c_name, c_nationkey from customer union all select 'part', p_name, null from part")
def union_tagged(spark, sf):
    s, c, p = (table(spark, sf, t) for t in ("supplier", "customer", "part"))
    return R.tagged_union({
        "supplier": s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        "customer": c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
        "part": p.select(F.col("p_name").alias("name")),
    })


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('MACHINERY', 'BUILDING') order by case c_mktsegment when 'MACHINERY' then 0 else 1 end, c_custkey limit 40")
def in_list_ordered(spark, sf):
    return S.page(R.in_order(table(spark, sf, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING", "MACHINERY"], ["c_custkey"]), 0, 40).select("c_custkey", "c_mktsegment")


@query(
    "with a as (select distinct o_custkey k from orders where year(o_orderdate) = 1994), b as (select distinct o_custkey k from orders where year(o_orderdate) = 1995) "
    "select k as o_custkey, 'added' as change from b where k not in (select k from a) union all select k, 'removed' from a where k not in (select k from b)"
)
def key_diff_added_removed(spark, sf):
    orders = table(spark, sf, "orders")
    return R.key_changes(orders.where("year(o_orderdate) = 1994"), orders.where("year(o_orderdate) = 1995"), "o_custkey")


@query(
    "with a as (select o_custkey k, count(*) v from orders where year(o_orderdate) = 1994 group by 1), b as (select o_custkey k, count(*) v from orders where year(o_orderdate) = 1995 group by 1) "
    "select coalesce(a.k, b.k) o_custkey, a.v as old, b.v as new, case when b.k is null then 'removed' when a.k is null then 'added' else 'changed' end as change from a full join b on a.k = b.k where a.v is distinct from b.v"
)
def full_outer_diff(spark, sf):
    of = lambda y: table(spark, sf, "orders").where(f"year(o_orderdate) = {y}").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    return R.row_changes(of(1994), of(1995), "o_custkey", "v")


# Statistics.


@query("select cast(ts as date) as day, event_type, count(*) visits from events group by 1, 2")
def daily_counts(spark, sf):
    return daily(table(spark, sf, "events"), "ts", ["event_type"]).select("day", "event_type", "visits")


@query("with c as (select user_id, event_type, count(*) visits from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20' group by 1, 2) select *, cast(sum(visits) over () as bigint) total from c")
def pair_counts_range(spark, sf):
    counts = stats.visit_counts(table(spark, sf, "events"), ["user_id", "event_type"], "2024-01-05", "2024-01-20", "ts")
    return stats.with_total(counts, "visits")


@query("with c as (select cast(ts as date) as day, count(*) visits from events group by 1) select max(visits) most, cast(sum(visits) as bigint) total, cast(floor(sum(visits) / count(*)) as bigint) mean from c")
def daily_summary(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("visits"))
    return stats.summary(counts, "visits")


@query(
    "select lang, cast(sum(n_chars) as bigint) chars_all, cast(coalesce(sum(case when quality = 1 then n_chars end), 0) as bigint) chars_main, count(*) texts_all, count(case when quality = 1 then 1 end) texts_main "
    "from documents left join labels using (doc_id) group by rollup (lang)"
)
def stats_rollup(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.totals(rows, "lang", {"chars": F.col("n_chars"), "texts": F.lit(1).cast("long")}, F.col("quality") == 1)


@query("select w as word, count(*) as rows, cast(sum(p_size) as bigint) as size from (select unnest(string_split(p_name, ' ')) w, p_size from part) group by 1")
def stats_multi(spark, sf):
    return stats.exploded_totals(table(spark, sf, "part"), F.split("p_name", " "), "word", {"size": F.col("p_size")})


@query(
    "with o(group_label, place, alias) as (values ('en/de', 0, 'en'), ('en/de', 0, 'de'), ('fr', 1, 'fr')) "
    "select coalesce(group_label, 'unknown') group_label, coalesce(place, 999) place, cast(sum(n_chars) as bigint) chars from documents left join o on lang = alias group by 1, 2"
)
def stats_merged_groups(spark, sf):
    order = spark.createDataFrame([("en/de", 0), ("fr", 1)], "aliases string, place int")
    return stats.merged_groups(table(spark, sf, "documents"), "lang", order, "aliases", {"chars": F.col("n_chars")})


@query("select lang, count(distinct source) sources, count(distinct case when n_chars > 2000 then source end) long_sources, max(n_chars) longest from documents group by 1")
def distinct_when(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("n_chars") > 2000, F.col("source"))).alias("long_sources"), F.max("n_chars").alias("longest")
    )


@query(
    "with a as (select l_orderkey k, count(*) l from lineitem group by 1), b as (select o_orderkey k, 4 r from orders) select coalesce(a.k, b.k) as okey, l as left_sum, cast(r as bigint) right_sum from a full join b on a.k = b.k where l is distinct from r"
)
def reconcile(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("okey"), F.lit(1).cast("long").alias("n"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("okey"), F.lit(4).cast("long").alias("n"))
    return stats.mismatches(lines, orders, "okey", "n")


@query("select md5(text) as digest, count(*) n from documents group by 1 having count(*) > 1")
def duplicates(spark, sf):
    return stats.repeated(table(spark, sf, "documents"), [F.md5(F.col("text").cast("binary")).alias("digest")])


@query(
    "select doc_id, length(text) chars, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) chars_no_spaces, "
    "len(regexp_extract_all(text, '[0-9a-zA-Z''\\-À-ÖØ-öø-ÿĀ-ſ]+')) en_words from documents"
)
def char_counters(spark, sf):
    counts = T.counters(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[counts[c].alias(c) for c in ("chars", "chars_no_spaces", "en_words")])


@query("select r_name, list_sort(list(n)) items from (select r_name, n_name || ':' || count(c_custkey) n from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name, n_name) group by 1")
def nested_groups(spark, sf):
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    rows = R.child_counts(n, c, "n_nationkey", "c_nationkey", "n").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return stats.nested(rows, ["r_name"], F.concat_ws(":", "n_name", "n"))


# Scalar functions.


@query(DOCS + "select doc_id, c as content, length(c) n from d")
def strip_puncs(spark, sf):
    return corpus(spark, sf).select("doc_id", "content", F.length("content").cast("long").alias("n"))


@query("select p_partkey, regexp_replace(p_name, '[aei]+', '<mark>\\0</mark>', 'g') marked from part")
def mark_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.mark_chars(F.col("p_name"), "aei").alias("marked"))


@query(
    "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) path from pages"
)
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.referer_host(F.col("url"), F.lit("")).alias("host"), F.coalesce(T.url_path(F.col("url")), F.lit("")).alias("path"))


@query(
    "with c as (select doc_id, 'CORPUS, T' || lpad(cast(doc_id % 55 + 1 as varchar), 2, '0') || ', no. ' || (doc_id % 2000) || ', p. ' || (doc_id % 900 + 1) || 'a' || (doc_id % 29 + 1) s from documents) "
    "select doc_id, 'T' || lpad(cast(doc_id % 55 + 1 as varchar), 2, '0') vol, lpad(cast(doc_id % 2000 as varchar), 4, '0') work, lpad(cast(doc_id % 900 + 1 as varchar), 4, '0') || 'a' || lpad(cast(doc_id % 29 + 1 as varchar), 2, '0') lb from c"
)
def citation_parse(spark, sf):
    n = F.col("doc_id")
    cited = F.concat(F.lit("CORPUS, T"), F.lpad((n % 55 + 1).cast("string"), 2, "0"), F.lit(", no. "), (n % 2000).cast("string"), F.lit(", p. "), (n % 900 + 1).cast("string"), F.lit("a"), (n % 29 + 1).cast("string"))
    parsed = table(spark, sf, "documents").select("doc_id", T.parse_citation(cited).alias("c"))
    return parsed.select("doc_id", "c.vol", T.work_number(F.col("c.work")).alias("work"), T.line_id(F.col("c.page"), F.col("c.col"), F.col("c.line")).alias("lb"))


@query("select event_id, regexp_extract(props, '\"k\": *(\\d+)', 1) k from events")
def json_props(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.coalesce(props["k"], F.lit("")).alias("k"))


# Without SQL: local alignment, segmentation, markup, versions.


@query()
def similar_passages(spark, sf):
    chunks = similar.chunks(corpus(spark, sf), "doc_id", "content")
    item = S.searchable(table(spark, sf, "benchmark")).orderBy("item_id").first().content
    return similar.similar(chunks, "doc_id", "content", item)


@query()
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query()
def segment_words(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return expand.segment(table(spark, sf, "part").select("p_partkey", "p_name"), F.replace("p_name", F.lit(" "), F.lit("")), words, "p_partkey").select("p_partkey", "segmented")


@query()
def version_diff(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", "turn")
    newer = turns.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.regexp_replace("text", "the", "a"), F.lit("."))).otherwise(F.col("text")))
    return versions.compare(turns.drop("turn"), newer.drop("turn"), "k", "text")


@query(DOCS + f"select doc_id, {sql_hits('of the')} term_hits, n_chars from d where lang = 'en' and contains(c, 'of the') order by term_hits desc, doc_id limit 100")
def flagship(spark, sf):
    """Phrase search with a filter, hit counts, order and page."""
    found = S.match(corpus(spark, sf).where(S.one_of("lang", "en")), '"of the"').select("doc_id", "term_hits", "n_chars")
    return S.page(S.order(found, "term_hits", ["doc_id"]), 0, 100)


# Catalog and ordered helpers.


@query(
    "with w as (select 'T' || lpad(cast(p_partkey as varchar), 5, '0') n, case when p_partkey % 10 = 0 then 'T' || lpad(cast(p_size as varchar), 2, '0') || '..T' || lpad(cast(p_size + 5 as varchar), 2, '0') "
    "else 'T' || lpad(cast(p_size as varchar), 2, '0') end vol from part) select n, vol from w where (not contains(vol, '..') and vol between 'T20' and 'T22') "
    "or (contains(vol, '..') and string_split(vol, '..')[1] <= 'T20' and string_split(vol, '..')[2] >= 'T22')"
)
def cross_range_containment(spark, sf):
    number = lambda c: F.concat(F.lit("T"), F.lpad(c.cast("string"), 2, "0"))
    size = F.col("p_size")
    works = table(spark, sf, "part").select(
        F.concat(F.lit("T"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("n"),
        F.when(F.col("p_partkey") % 10 == 0, F.concat(number(size), F.lit(".."), number(size + 5))).otherwise(number(size)).alias("vol"),
    )
    return catalog.in_volumes(works, "T", "T20", "T22")


@query("select conv_id, string_agg(text, '' order by turn) as text, count(*) parts from conversations group by 1")
def stitched_parts(spark, sf):
    return catalog.stitch(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


@query("select conv_id, turn, cast(row_number() over (partition by conv_id, role order by turn) as int) star from conversations")
def repeat_counters(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("target", F.concat_ws("-", "conv_id", "role"))
    return catalog.repeat_counter(rows, "target", ["turn"]).select("conv_id", "turn", "star")


@query("select lb1, lb2 from (select turn lb1, role, lead(role) over w r2, lead(turn) over w lb2 from conversations window w as (partition by conv_id order by turn)) where role = 'user' and r2 = 'assistant'")
def adjacent_lines(spark, sf):
    return catalog.adjacent(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "turn", "user", "assistant")


@query("select p_partkey, translate(p_name, 'ae', '12') as name from part")
def glyph_replacement(spark, sf):
    return table(spark, sf, "part").select("p_partkey", catalog.replace_glyphs(table(spark, sf, "part"), "p_name", {"a": "1", "e": "2"}, "[aeo]").alias("name"))


@query("select role as kind, count(*) n from conversations group by 1")
def counts_by_kind(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with k as (select distinct n_name k from nation), d as (select k, sha256(k) h from k) select d.k, coalesce(r.r_name, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)) as id "
    "from d left join region r on r.r_name = d.k"
)
def stable_identifiers(spark, sf):
    keys = table(spark, sf, "nation").select(F.col("n_name").alias("k"))
    known = table(spark, sf, "region").select(F.col("r_name").alias("k"), F.col("r_name").alias("id"))
    return R.stable_ids(keys, known, "k", "id")


@query("select o_orderkey, case when y < 0 then (-y) || ' BCE' else y || ' CE' end as label from (select o_orderkey, cast(year(o_orderdate) as int) - 1995 y from orders)")
def year_labels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.year_label(F.year("o_orderdate") - 1995).alias("label"))


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey = 1) and c_acctbal > 0")
def deny_by_lookup(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").where("n_regionkey = 1")
    return R.missing(c.where("c_acctbal > 0"), n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_mktsegment")
