"""The catalog: finding works, resolving citations to lines, alternates, rare characters, entity layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import canon_of, line_id, parse_citation, work_number
from ..plans.cut import cut
from ..plans.qlang import QueryError
from .relations import as_of, in_order, tagged_union
from .search import endpoint_inside, like, overlaps

#: Parameters of the works finder in the order in which the first one given wins.
FINDERS = ("work", "creator", "creator_id", "creator_name", "vol_start", "work_start", "time_start", "dynasty", "uuid")


def find_works(works: DataFrame, mode: str = "endpoint", **params: str) -> DataFrame:
    """Works by the first parameter that is given; an enclosing time span counts only in mode 'overlap'."""
    given = next((p for p in FINDERS if params.get(p)), None)
    if given is None:
        raise QueryError("a parameter is missing")
    v = params[given]
    if given == "work":
        return works.where(F.col("n") == v)
    if given in ("creator", "creator_name"):
        return works.where(like("creators", v)).orderBy("n")
    if given == "creator_id":
        return works.where(like("creators_with_id", f"({v})")).orderBy("n")
    if given == "vol_start":
        return in_volumes(works, params["canon"] if params.get("canon") else "", v, params.get("vol_end") or v)
    if given == "work_start":
        return works.where(F.col("n").between(v, params.get("work_end") or v)).orderBy("n")
    if given == "time_start":
        low, high = int(v), int(params.get("time_end") or v)
        test = overlaps if mode == "overlap" else endpoint_inside
        return works.where(test("time_from", "time_to", low, high)).orderBy("time_from", "n")
    if given == "dynasty":
        return in_order(works, "time_dynasty", v.split(","), ["n"])
    return works.where(F.col("uuid") == v)


def in_volumes(works: DataFrame, canon: str, first: str, last: str) -> DataFrame:
    """Works of volumes first to last, and works that span volumes ('v1..v2') around them; a work may come twice."""
    own = works.where(F.startswith("n", F.lit(canon)) & ~F.contains("vol", F.lit(".."))).where(F.col("vol").between(first, last))
    span = F.split("vol", r"\.\.")
    across = works.where(F.contains("vol", F.lit("..")) & F.startswith("n", F.lit(canon))).where((F.get(span, F.lit(0)) <= first) & (F.get(span, F.lit(1)) >= last))
    return own.unionByName(across).orderBy("n")


def look_up(q: str, catalog: DataFrame, works: DataFrame, toc: DataFrame) -> DataFrame:
    """By the query's shape: a volume, a work in a file name, a work's prefix, or a text searched in all three tables."""
    import re

    if m := re.fullmatch(r"([A-Z]+)(\d{2,3})", q):
        return tagged_union({"catalog": catalog.where(F.startswith("label", F.lit(q)))})
    if m := re.fullmatch(r"([A-Z]+)\d{2,3}n(\w+)", q):
        return tagged_union({"work": works.where(F.col("n") == m[1] + m[2])})
    if re.fullmatch(r"[A-Z]+\w?\d+\w?", q):
        return tagged_union({"work": works.where(F.startswith("n", F.lit(q)))})
    return tagged_union(
        {
            "catalog": catalog.where(like("label", q) & ~like("label", "=")),
            "work": works.where(like("title", q) & F.col("alt").isNull()),
            "toc": toc.where(like("label", q)),
        }
    )


def children(catalog: DataFrame, parent: str, works: DataFrame, node_key: str = "work", work_key: str = "n") -> DataFrame:
    """Entries below a node in order, one row each; a work's label is made from its number, title and fascicles.

    An entry's work is found by node_key and work_key, where ids name several works by a key of more than the id; of works
    that share a key the first one by title counts.
    """
    made_of = F.struct("title", "juan", "byline")
    known = works.where(F.col(work_key).isNotNull()).groupBy(F.col(work_key).alias("_n")).agg(F.min(made_of).alias("_w"))
    rows = catalog.where(F.col("parent") == parent).join(known, F.col(node_key) == F.col("_n"), "left")
    juan = F.col("_w.juan")
    made = F.concat_ws(" ", "work", F.concat(F.col("_w.title"), F.when(juan > 0, F.concat(F.lit(" ("), juan.cast("string"), F.lit("卷)"))).otherwise("")), F.nullif(F.col("_w.byline"), F.lit("")))
    return rows.withColumn("label", F.when(F.col("_n").isNotNull(), made).otherwise(F.col("label"))).drop("_n", "_w").orderBy("sort", "n")


def known_works(df: DataFrame, column: str, works: DataFrame, name: str = "work") -> DataFrame:
    """df with the work that each id means: itself if there is such a work (n), else the one with the letter A behind it, else null."""
    ids = works.select("n").distinct()
    plain, lettered = ids.select(F.col("n").alias("_plain")), ids.select(F.col("n").alias("_lettered"))
    both = df.join(plain, df[column] == F.col("_plain"), "left").join(lettered, F.concat(df[column], F.lit("A")) == F.col("_lettered"), "left")
    return both.withColumn(name, F.coalesce("_plain", "_lettered")).drop("_plain", "_lettered")


def alternates(works: DataFrame) -> DataFrame:
    """n, alt, place: the parts of alt ('a+b'), each a work id or the start of a line ('T01n0001_p0001a01')."""
    parts = works.where("alt is not null").select("n", F.posexplode(F.split("alt", r"\+")).alias("place", "part"))
    is_line = F.col("part").rlike(r"^[A-Z]+\d+n")
    as_work = F.concat(canon_of(F.col("part")), F.regexp_replace(F.regexp_extract("part", r"^[A-Z]+\d+n(.{5})", 1), "_", ""))
    return parts.select("n", "place", F.when(is_line, as_work).otherwise(F.col("part")).alias("alt"), F.when(is_line, F.col("part")).alias("linehead"))


def resolve(citations: DataFrame, column: str, lines: DataFrame, abbreviations: DataFrame | None = None, editions: DataFrame | None = None, nearest: bool = False) -> DataFrame:
    """Adds linehead and juan of the line that each citation names; of several the one of the smallest serial number.

    Abbreviations are read once more as citations; citations of the other edition go through its line map first. nearest:
    a place that no line has is the next line of its volume, behind the last one that one.
    """
    rows = cut(citations.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", parse_citation(F.col(column))))  # ids are fixed, and citations parsed once
    if abbreviations is not None:
        rows = rows.join(abbreviations.select(F.col("abbr").alias("_abbr"), F.col("ref").alias("_ref")), F.col("_c").isNull() & (F.col(column) == F.col("_abbr")), "left")
        rows = rows.withColumn("_c", F.coalesce("_c", parse_citation(F.col("_ref")))).drop("_abbr", "_ref")
    rows = rows.withColumns({"_vol": F.when(F.col("_c.kind").isin("juan", "volume page"), F.concat(F.lit("T"), F.col("_c.vol"))).when(F.startswith("_c.kind", F.lit("sequel")), F.concat(F.lit("R"), F.col("_c.vol"))).otherwise(F.col("_c.vol"))})
    rows = rows.withColumn("_lb", F.when(F.col("_c.page").isNotNull(), line_id(F.col("_c.page"), F.col("_c.col"), F.col("_c.line"))))
    if editions is not None:  # the first line of the map at or behind the place
        asked = rows.where(F.startswith("_c.kind", F.lit("sequel"))).select("_id", F.concat("_vol", F.lit("."), F.coalesce("_lb", F.lit(""))).alias("_p"), F.col("_vol").alias("_v"))
        known = editions.select(F.substring_index("lb1", ".", 1).alias("_v"), "lb1", F.col("lb2").alias("_x"))
        mapped = as_of(asked, known, ["_v"], "_p", "lb1", ["_x"], forward=True).select("_id", "_x")
        rows = rows.join(mapped, "_id", "left")
        rows = rows.withColumns({"_vol": F.coalesce(F.substring_index("_x", ".", 1), "_vol"), "_lb": F.coalesce(F.substring_index("_x", ".", -1), "_lb")}).drop("_x")
    # Two joins by equality: a place of a volume, a fascicle by its work and number. Both are one row, that of their first line.
    at = lines.select(F.col("vol").alias("_lv"), F.concat("page", "col", "line").alias("_ll"), F.col("linehead").alias("_lh"), F.col("juan").alias("_lj"), "ser_no", F.col("work").alias("_lw"))
    asked = rows.select("_id", F.col("_vol"), F.col("_lb"), (F.col("_c.kind") == "juan").alias("_by_juan"), F.col("_c.juan").cast("int").alias("_juan"), work_number(F.col("_c.work")).alias("_work"))
    in_place = at.groupBy("_lv", "_ll").agg(F.min_by(F.struct("_lh", "_lj", "ser_no"), F.when(F.col("_lh").isNotNull(), F.struct("ser_no", "_lh"))).alias("_f")).select("_lv", "_ll", "_f.*")
    by_line = asked.where("not _by_juan").join(in_place, (F.col("_lv") == F.col("_vol")) & (F.col("_ll") == F.col("_lb")))
    firsts = at.groupBy("_lv", "_lj", "_lw").agg(F.min_by(F.struct("_lh", "ser_no"), "ser_no").alias("_f"))  # a fascicle's lines are one row
    firsts = firsts.select("_lv", "_lj", F.col("_f._lh").alias("_lh"), F.col("_f.ser_no").alias("ser_no"), "_lw")
    by_juan = asked.where("_by_juan").join(firsts, (F.col("_lv") == F.col("_vol")) & (F.col("_lj") == F.col("_juan")) & F.endswith("_lw", F.col("_work")))
    both = by_line.select("_id", "_lh", "_lj", "ser_no").union(by_juan.select("_id", "_lh", "_lj", "ser_no"))
    if nearest:
        places = at.select(F.col("_lv").alias("_vol"), "_ll", "_lh", "_lj", "ser_no")
        lost = asked.where("not _by_juan and _lb is not null").join(by_line.select("_id"), "_id", "left_anti").select("_id", "_vol", "_lb")
        sides = as_of(lost, places, ["_vol"], "_lb", "_ll", ["_lh", "_lj", "ser_no"], forward=True)
        behind = sides.where("_lh is null").select("_id", "_vol", "_lb")
        both = both.unionByName(sides.where("_lh is not null").select("_id", "_lh", "_lj", "ser_no")).unionByName(as_of(behind, places, ["_vol"], "_lb", "_ll", ["_lh", "_lj", "ser_no"]).select("_id", "_lh", "_lj", "ser_no"))
    best = both.where("_lh is not null").groupBy("_id").agg(F.min_by(F.struct("_lh", "_lj"), F.struct("ser_no", "_lh")).alias("_best"))
    out = rows.select(*citations.columns, "_id").join(best, "_id", "left")
    return out.select(*citations.columns, F.col("_best._lh").alias("linehead"), F.col("_best._lj").alias("juan"))


def replace_glyphs(df: DataFrame, column: str, forms: Mapping[str, str], pattern: str = r"\[[^\]]+\]") -> Column:
    """Every match of pattern by its form; unknown ones stay. forms is a dictionary of rare characters, some thousands."""
    text = F.col(column)
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]) if forms else None
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    form = lambda t: F.coalesce(F.try_element_at(table, t), t) if table is not None else t
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("a"), found.alias("b")), lambda x: F.concat(x["a"], form(x["b"]))), ""), F.element_at(parts, -1))).otherwise(text)


def stitch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """One row for each key with the texts of its parts in order (a fascicle split over two files)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.array_join(parts, "").alias(text), F.count(F.lit(1)).alias("parts"))


def halves(files: DataFrame, work: Sequence[str], order: Sequence[str], juan: str, name: str = "half") -> DataFrame:
    """Which part of a fascicle a file holds: 2 if the file before ends in the same one, 1 if the next one goes on, else null."""
    w = Window.partitionBy(*work).orderBy(*order)
    return files.withColumn(name, F.when(F.lag(juan).over(w).eqNullSafe(F.col(juan)), 2).when(F.lead(juan).over(w).eqNullSafe(F.col(juan)), 1))


def unicode_levels(df: DataFrame, key: str, text: str, ranges: DataFrame, name: str = "lvl") -> DataFrame:
    """key, lvl: the highest level of a text's characters; ranges: low, high, lvl of code points, which don't overlap.

    Ranges are laid out in blocks of 256 code points, 4,352 of them in all, and met by the characters' blocks.
    """
    points = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c: c != ""))
    each = df.select(key, F.explode(points).alias("_c")).withColumn("_p", _code_point(F.col("_c")))
    blocks = ranges.select("low", "high", "lvl", F.explode(F.sequence(F.shiftright("low", 8), F.shiftright("high", 8))).alias("_block"))
    found = each.withColumn("_block", F.shiftright("_p", 8)).join(F.broadcast(blocks), "_block").where(F.col("_p").between(F.col("low"), F.col("high")))
    return found.groupBy(key).agg(F.max("lvl").alias(name))


def _code_point(c: Column) -> Column:
    """The code point of a character, by its big-endian UTF-32 bytes."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def repeat_counter(marks: DataFrame, target: str, order: Sequence[str], name: str = "star") -> DataFrame:
    """How often a reference mark's target has come up to this mark."""
    return marks.withColumn(name, F.row_number().over(Window.partitionBy(target).orderBy(*order)))


def adjacent(lines: DataFrame, group: Sequence[str], order: Sequence[str], edition: str, value: str, first: str, second: str) -> DataFrame:
    """lb1, lb2: a line break of one edition and the next one of the other edition right behind it."""
    w = Window.partitionBy(*group).orderBy(*order)
    both = lines.withColumns({"_ed": F.lead(edition).over(w), "lb2": F.lead(value).over(w)})
    return both.where((F.col(edition) == first) & (F.col("_ed") == second)).select(F.col(value).alias("lb1"), "lb2")


def insert_anchors(text: str, anchors: Sequence[tuple[int, str, str, str]]) -> tuple[str, list[str]]:
    """(text with anchors, mismatches). anchors: (place, 'start' or 'end', key, name) by place; the name at a start must stand there."""
    out, at, wrong = [], 0, []
    for place, kind, key, name in sorted(anchors, key=lambda a: (a[0], a[1] == "start")):
        if kind == "start" and name and text[place : place + len(name)] != name:
            wrong.append(f"{key}: {name} is not at {place}")
            continue
        out += [text[at:place], f'<a class="{kind}" data-key="{key}"></a>']
        at = place
    return "".join([*out, text[at:]]), wrong


def with_layers(lines: DataFrame, layers: DataFrame, key: str, text: str) -> DataFrame:
    """lines with the anchors of entity layers (key, position, type, entity, name) and the list of mismatches."""

    @F.pandas_udf(T.StructType().add("html", T.StringType()).add("mismatches", T.ArrayType(T.StringType())))
    def run(texts: pd.Series, anchors: pd.Series) -> pd.DataFrame:
        rows = [insert_anchors(t, [(a["position"], a["type"], a["entity"], a["name"]) for a in (x if x is not None else [])]) for t, x in zip(texts, anchors)]
        return pd.DataFrame(rows, columns=["html", "mismatches"])

    lists = layers.groupBy(key).agg(F.collect_list(F.struct("position", "type", "entity", "name")).alias("_anchors"))
    return lines.join(lists, key, "left").withColumn("_r", run.asNondeterministic()(F.col(text), F.col("_anchors"))).select(*lines.columns, "_r.html", "_r.mismatches")
