"""Further queries over the driver's tables: composed searches, lookups, citations, notes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .functions import text as T
from .operators import catalog, endpoints as E, expand, kwic, relations as R, search as S, similar, stats, versions
from .queries import DOCS, NEAR_SQL, corpus, places, query, sql_hits, table
from .sources import sinks


def _places():
    return F.array_join(F.transform("kwics", lambda x: x["pos"].cast("string")), ",").alias("places")


# Composed searches.


@query(
    places("to be") + f", m as (select doc_id, {sql_hits('to be')} term_hits from d where contains(c, 'to be') order by 2 desc, 1 limit 10 offset 5) "
    "select m.doc_id, m.term_hits, string_agg(cast(pos as varchar), ',' order by pos) places, arg_min(substr(h.c, greatest(1, pos-12), pos - greatest(1, pos-12)), pos) first_left from m join h using (doc_id) group by 1, 2"
)
def all_in_one(spark, sf):
    found = E.all_in_one(corpus(spark, sf), "doc_id", "content", '"to be"', order="term_hits", start=5, rows=10, around=12)
    return found.results.select("doc_id", "term_hits", _places(), F.get("kwics", F.lit(0))["left"].alias("first_left"))


TUPLES = NEAR_SQL + ", t as (select doc_id, p1, p2 from a join b using (doc_id) where (p2 >= p1 and p2-p1-6 <= 20) or (p2 < p1 and p1-p2-6 <= 20)) "


@query(TUPLES + "select doc_id, count(*) term_hits, string_agg(cast(least(p1, p2) as varchar), ',' order by least(p1, p2)) places from t group by 1 order by doc_id limit 15 offset 5")
def all_in_one_near(spark, sf):
    found = E.all_in_one(corpus(spark, sf), "doc_id", "content", '"of the" NEAR/20 "in the"', start=5, rows=15)
    return found.results.select("doc_id", "term_hits", _places())


@query(TUPLES + "select 'lang' facet, lang as value, count(distinct t.doc_id) docs, count(*) hits from t join documents using (doc_id) group by 2 union all select 'source', source, count(distinct t.doc_id), count(*) from t join documents using (doc_id) group by 2")
def near_facets(spark, sf):
    return E.all_in_one(corpus(spark, sf), "doc_id", "content", '"of the" NEAR/20 "in the"', facets=["lang", "source"]).facets


@query(TUPLES + "select count(distinct doc_id) num_found, count(*) total_term_hits from t")
def near_totals(spark, sf):
    return S.totals(S.match(corpus(spark, sf), '"of the" NEAR/20 "in the"', key="doc_id"))


@query(places("of the") + ", g as (select doc_id, pos from h where substr(c, pos, 8) <> 'of their') select doc_id, count(*) term_hits, string_agg(cast(pos as varchar), ',' order by pos) places from g group by 1 order by 2 desc, 1 limit 10")
def all_in_one_exclude(spark, sf):
    found = E.all_in_one(corpus(spark, sf), "doc_id", "content", '"of the" -"of their"', order="term_hits", rows=10)
    return found.results.select("doc_id", "term_hits", _places())


@query(
    DOCS + ", p as (select doc_id, c, unnest(range(1, length(c)+1)) pos from d where contains(c,'to be') or contains(c,'is and')), "
    "h as (select doc_id, c, pos, 'to be' keyword, 5 n from p where substr(c,pos,5)='to be' union all select doc_id, c, pos, 'is and', 6 from p where substr(c,pos,6)='is and') "
    "select doc_id, keyword, cast(pos as int) pos, substr(c, greatest(1, pos-8), pos - greatest(1, pos-8)) || '<mark>' || keyword || '</mark>' || substr(c, pos+n, 8) as text from h"
)
def concordance_of_keywords(spark, sf):
    return E.concordance(corpus(spark, sf), "doc_id", "content", "to be,is and,to be", 8).select("doc_id", "keyword", "pos", F.concat("left", "mark", "right").alias("text"))


@query(
    TUPLES + "select t.doc_id, cast(least(p1, p2) as int) pos, case when p1 <= p2 then '<mark>of the</mark>' || substr(c, p1+6, p2-p1-6) || '<mark>in the</mark>' "
    "else '<mark>in the</mark>' || substr(c, p2+6, p1-p2-6) || '<mark>of the</mark>' end mark, substr(c, greatest(1, least(p1,p2)-5), least(p1,p2) - greatest(1, least(p1,p2)-5)) as \"left\", substr(c, greatest(p1,p2)+6, 5) as \"right\" from t join d using (doc_id)"
)
def concordance_of_near(spark, sf):
    return E.concordance(corpus(spark, sf), "doc_id", "content", '"of the" NEAR/20 "in the"', 5).select("doc_id", "pos", "mark", "left", "right")


@query(
    DOCS + ", p as (select doc_id, c, unnest(range(1, length(c)+1)) pos from d where contains(c,'to be') or contains(c,'is and')), "
    "h as (select doc_id, pos, 'to be' keyword from p where substr(c,pos,5)='to be' union all select doc_id, pos, 'is and' from p where substr(c,pos,6)='is and') "
    "select doc_id, cast((pos-1)//80 as int) line, arg_max(keyword, pos) keyword, cast(max(pos) as int) pos from h group by 1, 2"
)
def concordance_by_line(spark, sf):
    found = E.concordance(corpus(spark, sf), "doc_id", "content", "to be,is and").withColumn("line", F.floor((F.col("pos") - 1) / 80).cast("int"))
    return E.one_for_each_line(found, ["doc_id", "line"]).select("doc_id", "line", "keyword", "pos")


def _notes(spark, sf) -> DataFrame:
    even = F.col("turn") % 2 == 0
    rows = table(spark, sf, "conversations").withColumn("note", F.expr("substring(text, 10)"))  # inline ones have the nine characters before it in front
    rows = rows.withColumns({"pre": F.when(even, F.substring("text", 1, 9)), "suf": F.when(even, F.concat(F.lit("zz"), F.expr("substring(text, 3)")))})
    return S.searchable(rows, "note")


MARKED = "regexp_replace(note, '(t[()*.\\[\\]—…‧─│┬△◎　、。〃〈〉《》「」『』【】〔〕〖〗︰！（）＊＋，－．／：；＜＝＞？［］～\\n0-9,]*h[()*.\\[\\]—…‧─│┬△◎　、。〃〈〉《》「」『』【】〔〕〖〗︰！（）＊＋，－．／：；＜＝＞？［］～\\n0-9,]*e)', '<mark>\\1</mark>', 'gi')"


@query(
    "with n as (select *, substr(text, 10) note from conversations), d as (select *, translate(lower(note), '" + T.ignored().replace("'", "''") + "', '') c from n), "
    f"m as (select conv_id, turn, {sql_hits('the')} term_hits, {MARKED} h, substr(text, 1, 9) pre, 'zz' || substr(text, 3) suf from d where contains(c, 'the')), "
    "x as (select *, regexp_extract(h, '(?s)^(.*?)(<mark>.*</mark>)(.*)$', 1) a, regexp_extract(h, '(?s)^(.*?)(<mark>.*</mark>)(.*)$', 2) b, regexp_extract(h, '(?s)^(.*?)(<mark>.*</mark>)(.*)$', 3) z from m) "
    "select conv_id, turn, term_hits, case when turn % 2 = 1 then h when b = '' then h else right(pre || '(' || a, 20) || b || left(z || ')' || suf, 20) end highlight from x"
)
def notes_search(spark, sf):
    return E.notes(_notes(spark, sf), "note", "content", '"the"', "pre", "suf", 20).select("conv_id", "turn", "term_hits", "highlight")


@query(
    "select conv_id, turn, substr(text, greatest(20 - 15, 0) + 1, 15) prefix, substr(text, 20 + 6 + 3, 15) suffix from conversations"
)
def note_contexts(spark, sf):
    prefix, suffix = T.note_context(F.col("text"), F.lit(20), F.lit(6), 15)
    return table(spark, sf, "conversations").select("conv_id", "turn", prefix.alias("prefix"), suffix.alias("suffix"))


@query(
    "select p_partkey, p_name, p_brand, p_size, regexp_replace(p_name, '[redbolt]+', '<mark>\\0</mark>', 'g') highlight from part "
    "where cast(contains(p_name,'r') as int)+cast(contains(p_name,'e') as int)+cast(contains(p_name,'d') as int)+cast(contains(p_name,'b') as int)+cast(contains(p_name,'o') as int)+cast(contains(p_name,'l') as int)+cast(contains(p_name,'t') as int) >= 3"
)
def title_search(spark, sf):
    part = table(spark, sf, "part")
    return E.titles(part.select("p_partkey", "p_name"), "p_name", "red bolt", part, "p_partkey", ["p_brand", "p_size"])


@query("select count(*) num_found, cast(coalesce(sum(n), 0) as bigint) total_term_hits from (" + DOCS + f"select {sql_hits('the')} n from d where contains(c, 'the'))")
def simplified_search(spark, sf):
    return E.simplified(corpus(spark, sf), "content", "t8e", {"8": "h", "9": "i"})


@query("select doc_id, translate(text, 'àé', 'ae') as text from documents")
def converted_script(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return expand.converted(docs, "text", {"à": "a", "é": "e"}, "other").select("doc_id", F.col("other").alias("text"))


@query("select distinct replace(replace(w, 'ﬁ', 'fi'), 'ﬂ', 'fl') spelling from (select unnest(string_split(p_name, ' ')) w from part)")
def ligature_variants(spark, sf):
    """Words of part names, and again with ligatures: what becomes equal is one."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("spelling"))
    joined = words.select(F.replace(F.replace("spelling", F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ")).alias("spelling"))
    return expand.without_ligatures(words.union(joined), "spelling", {"ﬁ": "fi", "ﬂ": "fl"})


WORDS = ["the", "of", "and", "in", "the", "tion"]


@query(
    "with w as (select doc_id, ' ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') || ' ' x, string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') ws from documents), "
    "f as (select doc_id, x, " + ", ".join(f"len(list_filter(ws, lambda y: y = '{w}')) n_{w}" for w in dict.fromkeys(WORDS)) + " from w), "
    "g as (select count(*) n, " + ", ".join(f"count_if(n_{w} > 0) d_{w}" for w in dict.fromkeys(WORDS)) + " from f) "
    "select doc_id, cast(greatest(0, " + ", ".join(f"case when contains(x, ' {' '.join(WORDS[i:j])} ') then {j - i} else 0 end" for i in range(6) for j in range(i + 1, 7)) + ") as int) lcs, "
    + "round(" + " + ".join(f"n_{w} * 2.2 / (n_{w} + 1.2) * greatest(0.0, ln((n - d_{w} + 1) / greatest(d_{w}, 1)))" for w in dict.fromkeys(WORDS))
    + ", 6) as bm25 from f, g where " + " + ".join(f"cast(n_{w} > 0 as int)" for w in dict.fromkeys(WORDS)) + " >= 2.5"
)
def ranked_candidates(spark, sf):
    return similar.ranked(table(spark, sf, "documents"), "doc_id", "text", WORDS, k=1_000_000).select("doc_id", "lcs", F.round("bm25", 6).alias("bm25"))


# Lookups.

WORK = "'T' || lpad(cast(p_partkey as varchar), 4, '0')"


def _works(spark, sf) -> DataFrame:
    """Works made of parts: n, vol, title, byline, juan, alt, creators, times."""
    k = F.col("p_partkey")
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    return table(spark, sf, "part").select(
        F.concat(F.lit("T"), F.lpad(k.cast("string"), 4, "0")).alias("n"), F.concat(F.lit("T"), size).alias("vol"), F.col("p_name").alias("title"), F.col("p_brand").alias("byline"),
        F.when(k % 7 == 0, F.concat(F.lit("T"), F.lpad((k + 1).cast("string"), 4, "0"), F.lit("+T"), size, F.lit("n"), F.lpad((k % 90).cast("string"), 4, "0"), F.lit("_p0001a01"))).alias("alt"),
        F.col("p_size").alias("juan"), F.col("p_type").alias("creators"), F.concat("p_type", F.lit("("), k.cast("string"), F.lit(")")).alias("creators_with_id"),
        (F.col("p_size") * 20).alias("time_from"), (F.col("p_size") * 20 + 50).alias("time_to"), F.col("p_type").alias("time_dynasty"), F.md5(k.cast("string")).alias("uuid"),
    )


@query(f"select {WORK} n from part where p_size * 20 between 400 and 600 or p_size * 20 + 50 between 400 and 600")
def find_works_by_time(spark, sf):
    return catalog.find_works(_works(spark, sf), time_start="400", time_end="600", dynasty="SMALL").select("n")


@query(f"select {WORK} n, p_type time_dynasty from part where p_type in ('SMALL', 'ECONOMY')")
def find_works_by_dynasty(spark, sf):
    return catalog.find_works(_works(spark, sf), dynasty="SMALL,ECONOMY").select("n", "time_dynasty")


@query(f"select {WORK} n from part where p_partkey between 20 and 60")
def find_works_by_range(spark, sf):
    return catalog.find_works(_works(spark, sf), work_start="T0020", work_end="T0060").select("n")


@query(f"select {WORK} n from part where contains(p_type || '(' || p_partkey || ')', '(12)')")
def find_works_by_creator(spark, sf):
    return catalog.find_works(_works(spark, sf), creator_id="12").select("n")


@query(f"select 'work' as type, {WORK} n from part where contains(p_name, 'red') and p_partkey % 7 <> 0 union all select 'toc', cast(n_nationkey as varchar) from nation where contains(n_name, 'red')")
def look_up_text(spark, sf):
    works = _works(spark, sf)
    none = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("n"), F.col("r_name").alias("label"))
    toc = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_name").alias("label"))
    return catalog.look_up("red", none, works, toc).select("type", "n")


@query(f"select 'work' as type, {WORK} n from part where lpad(cast(p_partkey as varchar), 4, '0') = '0012'")
def look_up_prefix(spark, sf):
    works = _works(spark, sf)
    none = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("n"), F.col("r_name").alias("label"))
    return catalog.look_up("T0012", none, works, none).select("type", "n")


@query(
    f"with w as (select {WORK} n, p_partkey k, lpad(cast(p_size as varchar), 2, '0') v from part where p_partkey % 7 = 0) "
    "select n, 0 as place, 'T' || lpad(cast(k + 1 as varchar), 4, '0') alt, null as linehead from w union all "
    "select n, 1, 'T' || lpad(cast(k % 90 as varchar), 4, '0'), 'T' || v || 'n' || lpad(cast(k % 90 as varchar), 4, '0') || '_p0001a01' from w"
)
def alternate_works(spark, sf):
    return catalog.alternates(_works(spark, sf))


@query(
    f"select {WORK} as work, {WORK} || ' ' || p_name || case when p_size > 0 then ' (' || p_size || '卷)' else '' end || ' ' || p_brand as label from part where p_size % 10 = 3 "
    "union all select null, p_name from part where p_size % 10 = 4 and p_partkey % 2 = 0"
)
def catalog_children(spark, sf):
    """Ids have four digits, so from part 10,000 on several works share one: an entry knows its work by uuid."""
    part = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    own = F.concat(F.lit("T"), F.lpad(k.cast("string"), 4, "0"))
    nodes = part.where((size % 10 == 3) | ((size % 10 == 4) & (k % 2 == 0))).select(
        F.lit("root").alias("parent"), k.cast("string").alias("n"), F.col("p_name").alias("label"), F.when(size % 10 == 3, own).alias("work"), F.lpad(k.cast("string"), 9, "0").alias("sort"),
        F.when(size % 10 == 3, F.md5(k.cast("string"))).alias("uuid"),
    )
    return catalog.children(nodes, "root", _works(spark, sf), "uuid", "uuid").select("work", "label")


LINES = (
    "with l as (select 'T' || lpad(cast(conv_id % 50 + 1 as varchar), 2, '0') vol, lpad(cast(conv_id as varchar), 4, '0') w, cast(turn // 4 + 1 as int) juan, lpad(cast(turn // 3 + 1 as varchar), 4, '0') page, "
    "chr(cast(97 + turn % 3 as int)) col, '01' as line, row_number() over (order by conv_id, turn) ser_no, conv_id, turn from conversations), "
    "m as (select *, vol || 'n' || w || '_p' || page || col || line linehead from l) "
)


def _lines(spark, sf) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    rows = R.serial(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    rows = rows.select(
        F.concat(F.lit("T"), pad(c % 50 + 1, 2)).alias("vol"), F.concat(F.lit("T"), pad(c, 4)).alias("work"), (F.floor(t / 4) + 1).cast("int").alias("juan"), pad(F.floor(t / 3) + 1, 4).alias("page"),
        F.chr(97 + t % 3).alias("col"), F.lit("01").alias("line"), "ser_no", "conv_id", "turn",
    )
    return rows.withColumn("linehead", T.linehead_of(F.col("vol"), F.col("work"), F.concat("page", "col", "line")))


@query(LINES + ", c as (select conv_id, turn, 'CORPUS, ' || vol || ', no. ' || conv_id || ', p. ' || (turn // 3 + 1) || col || '1' s, vol, page, col from m) select c.conv_id, c.turn, arg_min(m.linehead, m.ser_no) linehead, cast(arg_min(m.juan, m.ser_no) as int) juan from c join m on m.vol = c.vol and m.page = c.page and m.col = c.col group by 1, 2")
def resolve_citations(spark, sf):
    lines = _lines(spark, sf)
    cited = lines.select("conv_id", "turn", F.concat(F.lit("CORPUS, "), "vol", F.lit(", no. "), F.col("conv_id").cast("string"), F.lit(", p. "), (F.floor(F.col("turn") / 3) + 1).cast("string"), "col", F.lit("1")).alias("s"))
    return catalog.resolve(cited, "s", lines).select("conv_id", "turn", "linehead", "juan")


@query(LINES + "select n_nationkey, arg_min(linehead, ser_no) linehead from nation join m on m.vol = 'T' || lpad(cast(n_nationkey + 1 as varchar), 2, '0') and page = '0001' and col = 'a' group by 1")
def resolve_abbreviations(spark, sf):
    nation = table(spark, sf, "nation")
    refs = nation.select(F.col("n_name").alias("abbr"), F.concat(F.lit("T"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit(", no. 1, p. 1a1")).alias("ref"))
    return catalog.resolve(nation.select("n_nationkey", "n_name"), "n_name", _lines(spark, sf), abbreviations=refs).where("linehead is not null").select("n_nationkey", "linehead")


@query(LINES + "select r_regionkey, arg_min(linehead, ser_no) linehead from region join m on m.vol = 'T' || lpad(cast(r_regionkey + 1 as varchar), 2, '0') and page = '0002' and col = 'b' group by 1")
def resolve_other_edition(spark, sf):
    region = table(spark, sf, "region")
    number = F.lpad((F.col("r_regionkey") + 1).cast("string"), 3, "0")
    editions = region.select(F.concat(F.lit("R"), number, F.lit(".0861b05")).alias("lb1"), F.concat(F.lit("T"), F.substring(number, 2, 2), F.lit(".0002b01")).alias("lb2"))
    cited = region.select("r_regionkey", F.concat(F.lit("R"), number, F.lit(", p. 861b3")).alias("s"))
    return catalog.resolve(cited, "s", _lines(spark, sf), editions=editions).where("linehead is not null").select("r_regionkey", "linehead")


@query(LINES + "select conv_id, turn, linehead from m")
def lineheads(spark, sf):
    return _lines(spark, sf).select("conv_id", "turn", "linehead")


@query("select d.doc_id, text, l.quality, s.n as chapters from documents d left join labels l using (doc_id) left join (select conv_id, count(*) n from conversations group by 1) s on s.conv_id = d.doc_id where doc_id = 17")
def document_lookup(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("work"), "text")
    toc = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("work")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("toc"))
    works = table(spark, sf, "labels").select(F.col("doc_id").alias("work"), "quality", "toxic")
    found = E.document(texts, toc, works, work=17)
    return found.select("doc_id", "text", "work_info.quality", F.nullif(F.size("toc").cast("long"), F.lit(-1).cast("long")).alias("chapters"))


@query("select r_regionkey, r_name, count(n_nationkey) works from region left join nation on n_regionkey = r_regionkey group by 1, 2")
def collection_list(spark, sf):
    return E.collections(table(spark, sf, "region"), table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey").select("r_regionkey", "r_name", "works")


@query("select n_nationkey, c_custkey, md5(cast(c_custkey as varchar)) uuid from nation join customer on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation)")
def units_of_a_work(spark, sf):
    nation = table(spark, sf, "nation")
    first = nation.agg(F.min("n_name").alias("n_name"))
    units = table(spark, sf, "customer").withColumn("uuid", F.md5(F.col("c_custkey").cast("string")))
    return R.existing(nation, first, nation.n_name == first.n_name).join(units, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "c_custkey", "uuid")


@query("select doc_id, source from documents order by case when source = 'src7' then '00' when source = 'src3' then '01' else source end, lang, doc_id limit 60")
def canon_order(spark, sf):
    keys = spark.createDataFrame([("src7", "00"), ("src3", "01")], "source string, sort string")
    return S.page(E.in_canon_order(table(spark, sf, "documents"), keys, "source", "sort", ["lang", "doc_id"]), 0, 60).select("doc_id", "source")


@query("select conv_id, turn from conversations where conv_id = 5 and turn = 1")
def dynamic_equality(spark, sf):
    wanted = E.equal_to({"work": 5, "juan": 1, "other": 3}, {"work": "conv_id", "juan": "turn"}, {"juan": "work"})
    return table(spark, sf, "conversations").where(wanted).select("conv_id", "turn")


@query("select c_custkey, c_name from customer where c_custkey not in (3, 8)")
def export_allowed(spark, sf):
    return E.allowed(table(spark, sf, "customer"), "c_custkey", [3, 8]).select("c_custkey", "c_name")


# Statistics and ordered state.


@query(
    "with f as (select l_orderkey, l_linenumber, [cast(l_linenumber as int), cast(l_linenumber + l_linenumber % 2 as int)] j, cast(l_quantity as bigint) q from lineitem), "
    "x as (select *, lag(j[-1]) over (partition by l_orderkey order by l_linenumber) b from f), "
    "y as (select l_orderkey, l_linenumber, q, case when b is not distinct from j[1] then j[2:] else j end j from x) "
    "select l_orderkey, sum(q)::bigint q, array_to_string(flatten(list(j order by l_linenumber)), ',') juans from y group by 1"
)
def work_totals(spark, sf):
    n = F.col("l_linenumber").cast("int")
    files = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(n, n + n % 2).alias("juans"), F.col("l_quantity").cast("long").alias("q"))
    return stats.work_totals(files, "l_orderkey", "l_linenumber", "juans", ["q"]).select("l_orderkey", "q", F.array_join("juans", ",").alias("juans"))


@query(
    f"with w as (select {WORK} n, p_size, case when p_partkey % 7 = 0 then 'T' || lpad(cast(p_partkey + p_partkey % 2 as varchar), 4, '0') when p_partkey % 11 = 0 then '選錄' || p_name end alt from part) "
    "select count(*) works, cast(sum(p_size) as bigint) juans from w where alt is null or contains(alt, '選錄') or contains(alt, n)"
)
def own_text_totals(spark, sf):
    k = F.col("p_partkey")
    alt = F.when(k % 7 == 0, F.concat(F.lit("T"), F.lpad((k + k % 2).cast("string"), 4, "0"))).when(k % 11 == 0, F.concat(F.lit("選錄"), "p_name"))
    own = stats.has_text_of_its_own(F.concat(F.lit("T"), F.lpad(k.cast("string"), 4, "0")), alt)
    return table(spark, sf, "part").agg(F.count_if(own).alias("works"), F.sum(F.when(own, F.col("p_size"))).alias("juans"))


@query(
    "with recursive d as (select conv_id, turn, cast(case when turn % 5 = 0 then 1 when turn % 5 in (1, 3) then 2 else 3 end as int) dep from conversations), "
    "n as (select *, sum(cast(dep = 1 as int)) over (partition by conv_id order by turn) a from d), "
    "m as (select *, sum(cast(dep = 2 as int)) over (partition by conv_id, a order by turn) b from n), "
    "k as (select *, sum(cast(dep = 3 as int)) over (partition by conv_id, a, b order by turn) c from m) "
    "select conv_id, turn, case dep when 1 then cast(a as varchar) when 2 then a || '.' || b else a || '.' || b || '.' || c end number from k"
)
def outline_numbers(spark, sf):
    t = F.col("turn") % 5
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(t == 0, 1).when(t.isin(1, 3), 2).otherwise(3).alias("dep"))
    return R.outline(rows, "conv_id", "turn", "dep").select("conv_id", "turn", "number")


@query(
    "with f as (select l_orderkey, l_linenumber, cast(l_linenumber // 2 as int) juan from lineitem), g as (select *, lag(juan) over w b, lead(juan) over w a from f window w as (partition by l_orderkey order by l_linenumber)) "
    "select l_orderkey, l_linenumber, case when b is not distinct from juan then 2 when a is not distinct from juan then 1 end half from g"
)
def split_parts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_linenumber") / 2).cast("int").alias("juan"))
    return catalog.halves(rows, ["l_orderkey"], ["l_linenumber"], "juan").select("l_orderkey", "l_linenumber", "half")


@query("select cast(cast(o_orderdate as date) as varchar) ver, '# ' || cast(o_orderdate as date) || chr(10) || string_agg(o_orderstatus || o_orderkey, chr(10) order by o_orderkey) as text from orders group by cast(o_orderdate as date)")
def change_listing(spark, sf):
    """A day's orders as the changes of a version."""
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").cast("string").alias("ver"), "o_orderkey", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("line"))
    return sinks.listing(rows, "ver", ["o_orderkey"], "line")


# Scalar functions.

DIGIT = "list_extract(['零','一','二','三','四','五','六','七','八','九'], {} + 1)"


@query(
    "with n as (select o_orderkey k, cast(o_orderkey % 10000 as int) n from orders), d as (select *, n // 1000 a, n // 100 % 10 b, n // 10 % 10 c, n % 10 e from n) select k as o_orderkey, case when n = 0 then '零' when n < 10 then "
    + DIGIT.format("e") + " when n < 20 then '十' || case when e > 0 then " + DIGIT.format("e") + " else '' end else "
    "(case when a > 0 then " + DIGIT.format("a") + " || '千' else '' end) || (case when b > 0 then " + DIGIT.format("b") + " || '百' when a > 0 and n % 100 > 0 then '零' else '' end) || "
    "(case when c > 1 then " + DIGIT.format("c") + " || '十' when c = 1 then '十' when b > 0 and e > 0 then '零' else '' end) || (case when e > 0 then " + DIGIT.format("e") + " else '' end) end said from d"
)
def numerals(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.int_to_zht((F.col("o_orderkey") % 10000).cast("int")).alias("said"))


@query("select p_partkey, case when p_brand in ('Brand#1', 'Brand#2') then 'A' || lpad(cast(p_size as varchar), 3, '0') else 'T' || lpad(cast(p_size as varchar), 2, '0') end vol from part")
def volume_names(spark, sf):
    canon = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "A").otherwise("T")
    return table(spark, sf, "part").select("p_partkey", T.volume(canon, F.col("p_size").cast("string")).alias("vol"))


@query("select conv_id, turn, case when turn % 3 = 0 then contains(text, '.') else false end only_punctuation from conversations")
def punctuation_only(spark, sf):
    text = F.col("text")
    new = F.when(F.col("turn") % 3 == 0, F.replace(text, F.lit("."), F.lit(","))).when(F.col("turn") % 3 == 1, text).otherwise(F.concat(text, F.lit("x")))
    return table(spark, sf, "conversations").select("conv_id", "turn", versions.only_punctuation(text, new).alias("only_punctuation"))


@query(
    "with d as (select doc_id, text, lower(text) l from documents where contains(lower(text), 'to be')), p as (select doc_id, text, l, unnest(range(1, length(l) + 1)) pos from d), h as (select * from p where substr(l, pos, 5) = 'to be') "
    "select doc_id, cast(length(translate(substr(l, 1, pos - 1), '" + T.ignored().replace("'", "''") + "', '')) + 1 as int) pos, substr(text, greatest(1, pos - 9), pos - greatest(1, pos - 9)) || '<mark>' || substr(text, pos, 5) || '</mark>' || substr(text, pos + 5, 9) as text from h"
)
def context_with_punctuation(spark, sf):
    docs = corpus(spark, sf)
    found = kwic.occurrences(docs, "doc_id", "content", "to be", 1).join(docs.select("doc_id", "text", T.offset_map(F.col("text")).alias("_map")), "doc_id")
    return found.select("doc_id", "pos", kwic.with_punctuation(F.col("text"), F.col("_map"), F.col("pos"), F.lit(5), 9).alias("text")).where(F.contains(F.lower("text"), F.lit(">to be<")))


@query("select p_partkey, p_name || '(' || substr(p_name, 1, 2) || case when length(p_name) > 13 then '⋯中略' || (length(p_name) - 4) || '字⋯' || right(p_name, 2) else substr(p_name, 3) end || ')' as text from part")
def abridged_notes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.abridge_notes(F.concat("p_name", F.lit("("), "p_name", F.lit(")"))).alias("text"))


@query("select o_orderkey, cast(o_orderdate as date) a, make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) b from orders")
def parsed_dates(spark, sf):
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", T.date_of(at.cast("string").substr(1, 10)).alias("a"), T.date_of(year=F.year(at), month=F.month(at), day=F.dayofmonth(at)).alias("b"))


@query(
    "with c as (select doc_id, unnest(string_split(text, '')) ch from documents), u as (select doc_id, unicode(ch) p from c where length(ch) > 0) "
    "select doc_id, cast(max(case when p < 128 then 1 when p < 256 then 3 else 10 end) as int) lvl from u group by 1"
)
def unicode_levels(spark, sf):
    ranges = spark.createDataFrame([(0, 127, 1), (128, 255, 3), (256, 0x10FFFF, 10)], "low int, high int, lvl int")
    return catalog.unicode_levels(table(spark, sf, "documents"), "doc_id", "text", ranges).select("doc_id", "lvl")


@query("select event_id, format('{:,}', cast(event_id * 1234 as bigint)) n from events")
def thousands(spark, sf):
    return table(spark, sf, "events").select("event_id", T.thousands(F.col("event_id") * 1234).alias("n"))


@query("select doc_id, text like '%.' or text like '%,' or text like '%' || chr(10) or right(text, 1) in ('(', ')', '*', '[', ']', '0','1','2','3','4','5','6','7','8','9') ends from documents")
def ends_with_punctuation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ends_with_punc(F.col("text")).alias("ends"))
