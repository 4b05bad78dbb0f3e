"""Scalar text functions, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Punctuation that search ignores.
HALF_PUNCS = "()*.[]"
FULL_PUNCS = "—…‧─│┬△◎　、。〃〈〉《》「」『』【】〔〕〖〗︰！（）＊＋，－．／：；＜＝＞？［］～"
DIGITS = "0123456789"
# Characters that form a Latin word, and further ones that aren't counted as CJK.
EN_WORD = (
    r"0-9a-zA-Z'\-\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0100-\u017F\u0180-\u024F\u02BC\u0300-\u036F\u0370-\u04FF"
    r"\u1E00-\u1EFF\u2150-\u218F\u2460-\u24FF\u2C60-\u2C7F\uA720-\uA7FF\uAB30-\uAB6F\uFF10-\uFF19\uFF21-\uFF3A\uFF41-\uFF5A"
)
NOT_CJK = (
    EN_WORD + r"\u0000-\u00FF\u02B0-\u036F\u2000-\u206F\u2150-\u218F\u2190-\u22FF\u2460-\u26FF\u2C60-\u2C7F\u3000-\u3002\u3004"
    r"\u3008-\u3011\u3014-\u301F\u3030\u3037\u303D-\u303F\uFE30-\uFE6F\uFF01-\uFF64"
)
ZHT_DIGITS = "零一二三四五六七八九"
ZHT_UNITS = ["", "十", "百", "千"]


def ignored(digits: bool = False, comma: bool = False, space: bool = True) -> str:
    """The characters that search drops; the flags keep digits, half-width commas, blanks."""
    return HALF_PUNCS + FULL_PUNCS + "\n" + ("" if digits else DIGITS) + ("" if comma else ",") + ("" if space else " ")


def remove_puncs(c: Column, **keep: bool) -> Column:
    return F.translate(c, ignored(**keep), "")


def remove_puncs_from(s: str, **keep: bool) -> str:
    return s.translate({ord(x): None for x in ignored(**keep)})


def ends_with_punc(c: Column) -> Column:
    return F.coalesce(F.contains(F.lit(ignored()), F.substring(c, -1, 1)) & (F.length(c) > 0), F.lit(False))


def normal(c: Column) -> Column:
    """The form that is searched: lower case, without ignored characters."""
    return remove_puncs(F.lower(c))


def normal_query(q: str) -> str:
    return remove_puncs_from(q.lower())


def quoted(q: str) -> str:
    """q as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", q)


def hits(text: Column, q: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / len(q)).cast("long") if q else F.lit(0).cast("long")


def offset_map(c: Column) -> Column:
    """For each character that search keeps, its place in the text with punctuation (from 0)."""
    chars = F.split(c, "")
    kept = F.filter(F.transform(chars, lambda x, i: F.struct(x.alias("c"), i.alias("i"))), lambda x: ~F.contains(F.lit(ignored()), x["c"]))
    return F.transform(kept, lambda x: x["i"])


def int_to_zht(c: Column) -> Column:
    """Chinese numeral of an integer below 10,000."""
    digits = F.split(c.cast("string"), "")
    n = F.size(digits)
    units = F.array(*map(F.lit, ZHT_UNITS))
    said = F.transform(
        digits,
        lambda d, i: F.when(d != "0", F.concat(F.substring(F.lit(ZHT_DIGITS), d.cast("int") + 1, F.lit(1)), F.get(units, n - i - 1)))
        .otherwise("零"),
    )
    joined = F.regexp_replace(F.regexp_replace(F.array_join(said, ""), "零+", "零"), "一十", "十")
    return F.when(c == 0, F.lit("零")).otherwise(F.regexp_replace(joined, "零+$", ""))


def work_number(c: Column) -> Column:
    """Digits padded to four, behind them an optional letter; underscores go."""
    clean = F.replace(c, F.lit("_"), F.lit(""))
    return F.concat(F.lpad(F.regexp_extract(clean, r"^(\d+)", 1), 4, "0"), F.regexp_extract(clean, r"^\d+([A-Za-z]?)$", 1))


def volume(canon: Column, vol: Column, wide: tuple[str, ...] = ("A", "C", "G", "GA", "GB", "L", "M", "P", "U")) -> Column:
    """Canon and volume number of two digits, of three for the wide canons."""
    return F.concat(canon, F.when(canon.isin(*wide), F.lpad(vol, 3, "0")).otherwise(F.lpad(vol, 2, "0")))


def line_id(page: Column, col: Column, line: Column) -> Column:
    """page(4) col(1) line(2); a page letter stays in front; col and line default to a and 1."""
    letter, digits = F.regexp_extract(page, r"^([a-z]?)", 1), F.regexp_extract(page, r"(\d+)$", 1)
    padded = F.concat(letter, F.lpad(digits, 4, "0").substr(F.length(letter) + 1, F.lit(4)))
    return F.concat(padded, F.coalesce(F.nullif(col, F.lit("")), F.lit("a")), F.lpad(F.coalesce(F.nullif(line, F.lit("")), F.lit("1")), 2, "0"))


FIELDS = ("vol", "work", "page", "col", "line", "juan")


def _citation_forms(corpus: str) -> list[tuple[str, str]]:
    """(kind, pattern with named groups) of the citation formats, each put together from its parts, the first that fits counts.

    A format names a volume, a work, a fascicle, or a place of page, column and line, in this order.
    """
    volume, number = r"(?<vol>[A-Z]+\d+)", r"(?<work>[A-Za-z]?\d+[A-Za-z]?)"
    page, column, line = r"(?<page>[a-z]?\d+)", r"(?<col>[a-z])", r"(?<line>\d+)"
    comma, name = r"\s*,\s*", re.escape(corpus) + r"(?:\s+\w+\.\w+)?"
    western = lambda of: f"{volume}{comma}no\\.\\s*{number}{comma}pp?\\.\\s*{of}"
    optional = f"{page}(?:{column}(?:{line})?)?"
    taisho = r"《大正藏》冊(?<vol>\d+)，第\s*(?<work>\d+[A-Za-z]?)\s*號"
    return [
        ("linehead", rf"^(?<vol>[A-Z]+\d+)n(?<work>[^p]{{4,5}}_?)p(?<page>[a-z\d]\d{{3}}){column}{line}$"),
        ("cited", f"^{name}{comma}{western(f"{page}(?:{comma})?{column}{line}")}(?:\\s*-.*)?$"),
        ("paper", f"^{western(optional)}"),
        ("juan", rf"^{taisho}，卷(?<juan>\d+)"),
        ("volume page", rf"^{taisho}(?:，頁{optional})?"),
        ("sequel", f"《續藏經》冊(?<vol>\\d+)，頁{optional}"),
        ("sequel page", rf"^R(?<vol>\d+)(?:{comma}p\.\s*{optional})?$"),
    ]


def parse_citation(c: Column, corpus: str = "CORPUS") -> Column:
    """struct(kind, vol, work, page, col, line, juan) of the first format that fits; null if none does.

    corpus: the name that full citations begin with.
    """
    text = F.trim(c)
    out = F.lit(None)
    for kind, pattern in reversed(_citation_forms(corpus)):
        plain = re.sub(r"\(\?<\w+>", "(", pattern)
        groups = {name: i for i, name in enumerate(re.findall(r"(?<!\\)\((?:\?<(\w+)>|(?!\?))", pattern), start=1)}
        fields = [(F.nullif(F.regexp_extract(text, plain, groups[f]), F.lit("")) if f in groups else F.lit(None).cast("string")).alias(f) for f in FIELDS]
        out = F.when(text.rlike(plain), F.struct(F.lit(kind).alias("kind"), *fields)).otherwise(out)
    return out


def canon_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(GA|GB|[A-Z])", 1)


def mark_chars(c: Column, q: str) -> Column:
    """Every run of the query's characters in <mark>."""
    return F.regexp_replace(c, "[" + quoted(q) + "]+", "<mark>$0</mark>")


def mark_phrase(c: Column, q: str) -> Column:
    """The phrase in <mark>, with ignored characters allowed between its characters."""
    gap = "[" + quoted(ignored()).replace("\n", "\\n") + "]*"
    return F.regexp_replace(c, "(?iu)" + gap.join(quoted(x) for x in q), "<mark>$0</mark>")


def abridge_notes(c: Column, limit: int = 15) -> Column:
    """Notes in parentheses of more than limit characters become their ends and the number left out."""
    parts = F.split(c, r"(?=\([^()]*\))|(?<=\))")
    inner = lambda x: F.length(x) - 2
    short = lambda x: F.concat(F.substring(x, 1, 3), F.lit("⋯中略"), (inner(x) - 4).cast("string"), F.lit("字⋯"), F.substring(x, -3, 3))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\([^()]*\)$") & (F.length(x) > limit), short(x)).otherwise(x)), "")


def counters(c: Column) -> dict[str, Column]:
    """chars, chars_no_spaces, en_words, cjk_chars."""
    return {
        "chars": F.length(c).cast("long"),
        "chars_no_spaces": F.length(F.regexp_replace(c, r"\s", "")).cast("long"),
        "en_words": F.regexp_count(c, F.lit(f"[{EN_WORD}]+")).cast("long"),
        "cjk_chars": F.length(F.regexp_replace(c, f"[{NOT_CJK}]+", "")).cast("long"),
    }


def pick_glyph(uni: Column, norm_uni: Column, norm_big5: Column, composition: Column, normalise: bool = True) -> Column:
    """The first form of a rare character that isn't empty."""
    order = [uni, norm_uni, norm_big5, composition] if normalise else [uni, composition]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in order])


def url_path(c: Column) -> Column:
    """The path without a version in front; downloads are counted by their first two parts."""
    path = F.regexp_replace(F.parse_url(c, F.lit("PATH")), r"^/v\d+(?:\.\d+)*(?=/)", "")
    return F.when(F.startswith(path, F.lit("/download/")), F.substring_index(path, "/", 3)).otherwise(path)


def referer_host(referer: Column, ip: Column) -> Column:
    return F.coalesce(F.nullif(F.parse_url(referer, F.lit("HOST")), F.lit("")), ip)


def date_of(c: Column | None = None, year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
    """A date from a text, or from its parts, or today's."""
    if c is not None:
        return F.to_date(c)
    return F.make_date(year, month, day) if year is not None else F.current_date()


def note_context(text: Column, offset: Column, size: Column, around: int = 100) -> tuple[Column, Column]:
    """(prefix, suffix) of an inline note of `size` characters, whose opening parenthesis stands at offset (from 0)."""
    start = F.greatest(offset - around, F.lit(0))
    return F.substring(text, start + 1, offset - start), F.substring(text, offset + size + 3, F.lit(around))


def note_inline(prefix: Column, highlight: Column, suffix: Column, around: int = 30) -> Column:
    """A marked note between what stands around it, cut to `around` characters before and behind the marks."""
    part = lambda i: F.regexp_extract(highlight, r"(?s)^(.*?)(<mark>.*</mark>)(.*)$", i)
    before, after = F.concat(prefix, F.lit("("), part(1)), F.concat(part(3), F.lit(")"), suffix)
    return F.when(part(2) == "", highlight).otherwise(F.concat(F.right(before, F.lit(around)), part(2), F.left(after, F.lit(around))))


def linehead_of(vol: Column, work: Column, lb: Column) -> Column:
    """The line's full name: volume, n, work number (without the letter that parts of one long work have), p, line."""
    number = F.regexp_replace(F.substring(work, F.length(canon_of(work)) + 1, F.lit(99)), "^(0220)[a-z]$", "$1")
    return F.concat(vol, F.lit("n"), number, F.when(number.rlike("[A-Za-z]$"), F.lit("p")).otherwise(F.lit("_p")), lb)


def year_label(c: Column) -> Column:
    return F.when(c < 0, F.concat((-c).cast("string"), F.lit(" BCE"))).otherwise(F.concat(c.cast("string"), F.lit(" CE")))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def elapsed(seconds: float) -> str:
    """Seconds in words."""
    whole = int(seconds)
    parts = [(whole // 3600, "hour"), (whole % 3600 // 60, "minute"), (whole % 60, "second")]
    return " ".join(f"{n} {unit}{'s' * (n != 1)}" for n, unit in parts if n) or "0 seconds"


def expand_font_span(c: Column) -> Column:
    """Characters beyond the basic plane's common fonts in a span of their own."""
    return F.regexp_replace(c, r"[\x{2B820}-\x{2EBEF}]+", '<span class="ext">$0</span>')


def style_class(c: Column) -> Column:
    """The class of a style of margin-left and text-indent in em: m2, i1, j1 (an indent to the left), m2_i1; null for other styles."""
    plain = F.regexp_replace(c, r"\s", "")
    keys = F.array_sort(F.transform(F.filter(F.split(plain, ";"), lambda x: x != ""), lambda x: F.substring_index(x, ":", 1)))
    whole = lambda key: F.coalesce(F.nullif(F.regexp_extract(plain, rf"(?:^|;){key}:(-?\d+)", 1), F.lit("")), F.lit("0")).cast("int")
    margin, indent = F.concat(F.lit("m"), whole("margin-left").cast("string")), whole("text-indent")
    moved = F.when(indent >= 0, F.concat(F.lit("i"), indent.cast("string"))).otherwise(F.concat(F.lit("j"), (-indent).cast("string")))
    is_keys = lambda *k: keys == F.array(*map(F.lit, k))
    return F.when(is_keys("margin-left"), margin).when(is_keys("text-indent"), moved).when(is_keys("margin-left", "text-indent"), F.concat_ws("_", margin, moved))


def escaped_html(c: Column, quotes: bool = False) -> Column:
    for x, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        c = F.replace(c, F.lit(x), F.lit(entity))
    return c


def html_tag(name: str, attributes: dict[str, Column], body: Column | None = None) -> Column:
    """An element; attributes that are null are left out, body is markup, without one the element is empty."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), escaped_html(v.cast("string"), True), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    if body is None:
        return F.concat(F.lit(f"<{name}"), *parts, F.lit("/>"))
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"), F.coalesce(body, F.lit("")), F.lit(f"</{name}>"))
