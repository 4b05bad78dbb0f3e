"""Entity layers: marking names in lines by positions that were taken from another state of the text.

A layer's row says that at a position of a line (from 1 on) a name of an entity starts or ends. The line may have
changed since, and may write the name with variant characters. Names and lines are compared by character classes: the
connected components of a table of variants. Along a line a drift is carried: how far the last name stood from where its
row said. A name that isn't at its position plus the drift is looked for on both sides, up to `reach` characters, and the
nearest place counts, of two equally near ones the earlier. What can't be placed is listed with its reason.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.cut import cut
from .relations import components

REACH = 8
NO_LINE, UNKNOWN_TYPE, OUTSIDE, OTHER_TEXT = "no such line", "unknown type", "position outside the text", "other text at the position"


def variant_classes(variants: DataFrame) -> DataFrame:
    """char, class from (k, vars): a character and its variants, parted by commas; only single characters count."""
    pairs = variants.select(F.col("k").alias("a"), F.explode(F.split("vars", r"\s*,\s*")).alias("b")).where((F.length("a") == 1) & (F.length("b") == 1))
    return components(pairs).select(F.col("node").alias("char"), F.col("label").alias("class"))


def in_classes(text: Column, classes: DataFrame | None) -> Column:
    """The text with every character by its class. classes: a table of characters, so at most one row for each code point."""
    if classes is None:
        return text
    rows = classes.where("char <> class").orderBy("char").collect()
    return F.translate(text, "".join(r["char"] for r in rows), "".join(r["class"] for r in rows)) if rows else text


def _stands(line: str, name: str, kind: str, at: int) -> bool:
    """Whether the name starts at (or ends before) the place, as far as the line goes; at least one character of it."""
    if kind == "start":
        there = line[at : at + len(name)]
        return bool(there) and name.startswith(there)
    there = line[max(0, at - len(name)) : at]
    return bool(there) and name.endswith(there)


def place(line: str, anchors: Sequence[tuple[int, str, str | None]], reach: int = REACH) -> list[tuple[int | None, str | None]]:
    """(place from 0 on, None) or (None, reason) of each (position, start or end, name) of a line, in their order."""
    out, drift = [], 0
    for position, kind, name in anchors:
        if kind not in ("start", "end"):
            out.append((None, UNKNOWN_TYPE))
            continue
        told = position - 1 if kind == "start" else position  # an end's anchor stands behind its character
        expected = told + drift
        if not name:
            out.append((expected, None) if 0 <= expected <= len(line) else (None, OUTSIDE))
            continue
        nearest = (p for d in range(reach + 1) for p in ((expected - d, expected + d) if d else (expected,)) if 0 <= p <= len(line))
        found = next((p for p in nearest if _stands(line, name, kind, p)), None)
        if found is None:
            out.append((None, OUTSIDE if not 0 <= expected <= len(line) else OTHER_TEXT))
            continue
        drift = found - told
        out.append((found, None))
    return out


def _marked(text: str, anchors: list[tuple[int, str, str, str]]) -> str:
    """The text with anchors (place, kind, tag, entity); at one place what ends comes before what starts."""
    out, at = [], 0
    for p, kind, tag, entity in sorted(anchors, key=lambda a: (a[0], a[1] == "start")):
        out += [text[at:p], f'<a class="{tag}_{kind}" data-key="{entity}"></a>']
        at = p
    return "".join([*out, text[at:]])


def with_layers(lines: DataFrame, layers: DataFrame, key: Sequence[str], text: str, variants: DataFrame | None = None, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(lines with `html` and `placed`, mismatches).

    layers: the columns of key, position, type, tag, entity, name; rows that repeat count once. mismatches: the same with
    reason. A line's anchors are put in the order of their positions, ends first. Every line stays, also without anchors.
    """
    classes = variant_classes(variants) if variants is not None else None
    names = [f"k{i}" for i in range(len(key))]
    wanted = layers.select(*[F.col(c).alias(n) for c, n in zip(key, names)], "position", "type", "tag", "entity", "name").distinct()
    wanted = wanted.withColumn("plain", in_classes(F.col("name"), classes))
    order = F.struct("position", (F.col("type") != "end").alias("starts"), "type", "tag", "entity", "name", "plain")
    held = wanted.groupBy(*names).agg(F.array_sort(F.collect_list(order)).alias("anchors"))  # of one line
    own = lines.select(*[F.col(c).alias(n) for c, n in zip(key, names)], F.col(text).alias("text"))
    rows = own.select(*names, "text", in_classes(F.col("text"), classes).alias("classed")).join(held, names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    wrong = "array<struct<position:int,type:string,tag:string,entity:string,name:string,reason:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            htmls, placed, mismatches = [], [], []
            for line, classed, anchors in zip(*[batch.column(len(names) + i).to_pylist() for i in range(3)]):
                line, classed = line or "", classed or ""
                places = place(classed, [(a["position"], a["type"], a["plain"]) for a in anchors], reach)
                good = [(p, a["type"], a["tag"], a["entity"]) for a, (p, reason) in zip(anchors, places) if reason is None]
                htmls.append(_marked(line, good))
                placed.append(len(good))
                mismatches.append([{k: a[k] for k in ("position", "type", "tag", "entity", "name")} | {"reason": reason} for a, (_, reason) in zip(anchors, places) if reason])
            item = pa.struct([("position", pa.int32()), *[(k, pa.string()) for k in ("type", "tag", "entity", "name", "reason")]])
            schema = schema or [*names, "html", "placed", "mismatches"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(htmls, pa.string()), pa.array(placed, pa.int32()), pa.array(mismatches, pa.list_(item))], schema)

    done = cut(rows.mapInArrow(run, f"{kinds}, html string, placed int, mismatches {wrong}"))
    back = lambda df, *more: df.select(*[F.col(n).alias(c) for n, c in zip(names, key)], *more)
    kept = back(done, "html", "placed")
    marked = lines.join(kept, list(key), "left").withColumns({"html": F.coalesce("html", F.col(text)), "placed": F.coalesce("placed", F.lit(0))}).select(*lines.columns, "html", "placed")
    missing = wanted.join(own.select(*names).distinct(), names, "left_anti").withColumn("reason", F.lit(NO_LINE))
    columns = ["position", "type", "tag", "entity", "name", "reason"]
    listed = back(done.select(*names, F.explode("mismatches").alias("m")), *[f"m.{c}" for c in columns])
    return marked, listed.unionByName(back(missing, *columns))
