"""SQL (DuckDB) for the operators that it can express."""

from __future__ import annotations

from .minhash_forest import DENOMINATOR, NUMERATOR
from .quality_rules import MIDDLE, MIN_GROUP, MIN_WORDS, REACH, RULES, UPPER

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    """Exact quantiles: those of a sketch that has held every value, as it does up to some thousand texts a group."""
    share = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0 end"
    shares = {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "bar_share": share("n_bars", "n_words"),
    }
    quantiles = ", ".join(f"quantile_disc({n}, {q}) {n}_{mark}" for n in RULES for q, mark in ((MIDDLE, "middle"), (UPPER, "upper")))
    pick = lambda c: f"case when g.n >= {MIN_GROUP} then g.{c} when l.n >= {MIN_GROUP} then l.{c} else a.{c} end"
    fence = lambda n, size, event: f"{n} <= {pick(n + '_upper')} + {REACH} * greatest({pick(n + '_upper')} - {pick(n + '_middle')}, {event} / greatest({size}, 1))"
    fences = " and ".join(fence(n, *rule) for n, rule in RULES.items())
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    return f"""with t as (select doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) ls from t),
g3 as (select doc_id, i, array_to_string(ws[i:i + 2], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from g3) where c > 1),
covered as (select doc_id, count(distinct k) n from (select doc_id, unnest([i, i + 1, i + 2]) k from again) group by 1),
m as (select w.doc_id, lang, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars, {count('[#*$%&|<>]')} n_symbols,
  len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, len(ls) n_lines, {count('[A-Z]')} n_upper, {count('[|]')} n_bars
  from w left join covered using (doc_id)),
s as (select *, {', '.join(f'{sql} {n}' for n, sql in shares.items())} from m),
g as (select lang, source, count(*) n, {quantiles} from s group by 1, 2),
l as (select lang, count(*) n, {quantiles} from s group by 1),
a as (select {quantiles} from s),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fences} kept, {', '.join(RULES)}
from b left join g on b.lang is not distinct from g.lang and b.source is not distinct from g.source left join l on b.lang is not distinct from l.lang cross join a"""


def near_duplicates() -> str:
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where {DENOMINATOR} * c >= {NUMERATOR} * (na.n + nb.n - c)),
edges as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id other from documents union select r.doc_id, edges.b from r join edges on r.other = edges.a),
k as (select doc_id, min(other) component_id from r group by 1)
select doc_id, coalesce(n.n, 0) n_shingles, component_id, doc_id = component_id kept from k left join n using (doc_id)"""


_FIM = ("<P>", "<S>", "<M>")


def fill_in_middle() -> str:
    h = lambda k: f"('0x' || substr(x, {8 * (k - 1) + 1}, 8))::bigint"
    p, s, m = _FIM
    plain = " or ".join(["n = 0", *[f"contains(t, '{mark}')" for mark in _FIM], f"{h(3)} % 100 >= 90"])
    return f"""with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(doc_id::varchar, '')) x from documents),
c as (select *, least({h(1)} % (n + 1), {h(2)} % (n + 1)) a, greatest({h(1)} % (n + 1), {h(2)} % (n + 1)) b, case when {plain} then 'plain' when {h(4)} % 100 < 20 then 'spm' else 'psm' end form from d),
o as (select *, substr(t, 1, a) prefix, substr(t, a + 1, b - a) middle, substr(t, b + 1) suffix from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle when 'spm' then '{s}' || suffix || '{p}' || prefix || '{m}' || middle else t end) output_sha256,
  sha256(case form when 'plain' then t else prefix || middle || suffix end) restored_sha256
from o"""


def importance() -> str:
    """CRC-32 is computed for each distinct word, byte by byte, from a table that its rule gives."""
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    return f"""with recursive r as (select i, 0 k, i::bigint x from range(256) q(i) union all select i, k + 1, {step} from r where k < 8),
crc_table as (select list(x order by i) places from r where k = 8),
d as (select doc_id, {words('text')} w from documents), b as (select {words('text')} w from benchmark),
dw as (select doc_id, unnest(w) word from d), bw as (select unnest(w) word from b),
distinct_words as (select word from dw union select word from bw),
bytes as (select word, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint) v from distinct_words),
crc as (select word, xor(list_reduce(v, lambda a, y: xor(places[(xor(a, y) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295) % 10000 bucket from bytes, crc_table),
n as (select range bucket from range(10000)),
s as (select bucket, count(*) c from dw join crc using (word) group by 1), t as (select bucket, count(*) c from bw join crc using (word) group by 1),
total as (select (select count(*) from dw) s, (select count(*) from bw) t),
gain as (select n.bucket, floor(1000 * ln((coalesce(t.c, 0) + 1)::double * (total.s + 10000)::double / ((coalesce(s.c, 0) + 1)::double * (total.t + 10000)::double)))::bigint g
  from n left join s using (bucket) left join t using (bucket), total),
weight as (select doc_id, sum(g)::bigint w from dw join crc using (word) join gain using (bucket) group by 1),
h as (select doc_id, len(w) n_words, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h from d),
scored as (select h.doc_id, n_words, coalesce(w, 0)::bigint weight, coalesce(w, 0)::bigint + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296)))::bigint score from h left join weight using (doc_id)),
placed as (select *, row_number() over (order by n_words < 20, score desc, doc_id) place, count(*) filter (n_words >= 20) over () eligible from scored)
select doc_id, n_words::bigint n_features, weight, score, case when n_words >= 20 and place <= 10 * eligible // 100 then place end rank, n_words::bigint n_words from placed"""


SQL = {"op3_quality_rules": quality_rules(), "op10_minhash_forest": near_duplicates(), "op11_importance": importance(), "op13_fill_in_middle": fill_in_middle()}
