"""Statistics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def visit_counts(visits: DataFrame, by: Sequence[str | Column], low, high, at: str, count: Column | None = None) -> DataFrame:
    """Visits of the days from low to high, both included, by group."""
    rows = visits.where((F.col(at) >= F.to_date(F.lit(low))) & (F.col(at) < F.date_add(F.to_date(F.lit(high)), 1)))
    return rows.groupBy(*by).agg((F.sum(count) if count is not None else F.count(F.lit(1))).alias("visits"))


def summary(counts: DataFrame, value: str) -> DataFrame:
    """max, sum and whole-number average: one row."""
    return counts.agg(F.max(value).alias("most"), F.sum(value).alias("total"), F.floor(F.sum(value) / F.count(value)).alias("mean"))


def with_total(counts: DataFrame, value: str, total: str = "total") -> DataFrame:
    return counts.join(F.broadcast(counts.agg(F.sum(value).alias(total))))


def totals(df: DataFrame, group: str, measures: dict[str, Column], main: Column) -> DataFrame:
    """Each measure over all rows and over main rows, by group, and a row for the whole (group null) by rollup."""
    sums = []
    for name, m in measures.items():
        sums += [F.coalesce(F.sum(m), F.lit(0)).alias(f"{name}_all"), F.coalesce(F.sum(F.when(main, m)), F.lit(0)).alias(f"{name}_main")]
    return df.rollup(group).agg(*sums)


def has_text_of_its_own(work: Column, alt: Column) -> Column:
    """Whether a work counts: it refers to no other one, or only in part, or to itself."""
    return alt.isNull() | F.contains(alt, F.lit("選錄")) | F.contains(alt, work)


def work_totals(files: DataFrame, work: str, order: str, juans: str, measures: Sequence[str]) -> DataFrame:
    """Sums over the files of each work, and its fascicles in order; one that goes on in the next file counts once."""
    join = lambda acc, x: F.concat(acc, F.when((F.size(acc) > 0) & (F.size(x) > 0) & F.get(acc, F.size(acc) - 1).eqNullSafe(F.get(x, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x))
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, juans))), lambda x: x[juans])
    out = files.groupBy(work).agg(lists.alias("_lists"), *[F.sum(m).alias(m) for m in measures])
    return out.withColumn(juans, F.aggregate("_lists", F.array().cast(files.schema[juans].dataType), join)).drop("_lists")


def exploded_totals(df: DataFrame, values: Column, name: str, measures: dict[str, Column]) -> DataFrame:
    """Sums by each element of a multi-valued column; together they exceed the whole."""
    rows = df.select(*df.columns, F.explode(values).alias(name))
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(n) for n, m in measures.items()])


def merged_groups(df: DataFrame, label: str, order: DataFrame, aliases: str, measures: dict[str, Column], last: int = 999) -> DataFrame:
    """Groups whose labels are joined by '/' in the order table count as one; unknown labels last."""
    spread = order.select(F.col(aliases).alias("group_label"), F.col("place"), F.explode(F.split(aliases, "/")).alias("_alias"))
    joined = df.join(spread, df[label] == spread["_alias"], "left")
    return joined.groupBy(F.coalesce("group_label", F.lit("unknown")).alias("group_label"), F.coalesce("place", F.lit(last)).alias("place")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])


def mismatches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose sums differ between two tables, or that one of them lacks."""
    a = left.groupBy(key).agg(F.sum(value).alias("left_sum"))
    b = right.groupBy(key).agg(F.sum(value).alias("right_sum"))
    return a.join(b, key, "full").where(~F.col("left_sum").eqNullSafe(F.col("right_sum")))


def repeated(df: DataFrame, key: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: Sequence[str]) -> None:
    found = repeated(df, key).limit(5).collect()
    if found:
        raise ValueError(f"{key} repeats: {found}")


def nested(df: DataFrame, levels: Sequence[str], leaf: Column, name: str = "items") -> DataFrame:
    """Nested arrays of structs, one level after the other from the innermost."""
    out = df.groupBy(*levels).agg(F.array_sort(F.collect_list(leaf)).alias(name))
    for i in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:i]).agg(F.array_sort(F.collect_list(F.struct(levels[i], name))).alias(name))
    return out
