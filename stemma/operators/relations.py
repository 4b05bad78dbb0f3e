"""Relational operators: lookups, as-of and recursive joins, set operations, ordered-state operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.cut import cut

MOST_LEVELS = 100_000


GROUP_ROWS = 1_000_000


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, take: Sequence[str], forward: bool = False) -> DataFrame:
    """Each row of left with the columns `take` of the last row of right at or before it, in the same group; forward: of the
    first one at or behind it.

    Both sides are put in one order and the last right row is carried on: no row pairs.
    """
    value = F.struct(F.col(right_at).alias("_r_at"), *take)
    a = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"))
    b = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_value"))
    both = carried(a.unionByName(b), by, [F.desc("_at") if forward else F.asc("_at"), F.asc("_side")], F.col("_value"), "_value")
    return both.where("_side = 1").select("_row.*", *[F.col(f"_value.{c}").alias(c) for c in take])


def carried(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str, before: bool = False) -> DataFrame:
    """df with the last value that isn't null of the rows up to each one in its group (before: of the rows before it).

    Groups of up to GROUP_ROWS rows are windows. If there is a larger one, rows are dealt by ranges of (group, order), so
    that a group spreads over tasks, and what a range's first group needs from the ranges before is handed on.
    """
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    if (largest or 0) <= GROUP_ROWS:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(up_to(Window.partitionBy(*group).orderBy(*order))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumn("_v", value).repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    rows = cut(ranged.withColumns({"_own": F.last("_v", ignorenulls=True).over(up_to(inside)), "_n": F.row_number().over(inside), "_to": F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))}))
    tails = rows.groupBy(*group, "_part").agg(F.max_by("_to", "_n").alias("_tail"))
    several = tails.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    same = _all_same([(F.col(c), F.col(f"_g{i}")) for i, c in enumerate(group)])
    ends = tails.join(several, same, "left_semi")  # two for each border between ranges at most
    handed = ends.withColumn("_handed", F.last("_tail", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    handed = handed.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_handed")
    out = rows.join(handed, same & (F.col("_part") == F.col("_p")), "left").withColumn(name, F.coalesce("_own", "_handed"))
    return out.select(*dict.fromkeys([*df.columns, name]))


def _all_same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out = out & x.eqNullSafe(y)
    return out


def first_by(df: DataFrame, group: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group; give an order without ties."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def ends(df: DataFrame, group: Sequence[str], value: str, at: Column) -> DataFrame:
    """first and last value of each group, by partial aggregation."""
    return df.groupBy(*group).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def to_list(df: DataFrame, group: Sequence[str], value: Column, name: str, separator: str = ",") -> DataFrame:
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(value.cast("string"))), separator).alias(name))


def enrich(rows: DataFrame, names: DataFrame, on: Column, take: dict[str, str]) -> DataFrame:
    """Left lookup: Spark broadcasts the dictionary if its measured size is small."""
    return rows.join(names, on, "left").select(rows["*"], *[names[c].alias(a) for c, a in take.items()])


def require(df: DataFrame, column: str) -> DataFrame:
    """Fails the query if a mandatory lookup found nothing."""
    return df.where(F.assert_true(F.col(column).isNotNull(), f"{column} is missing").isNull())


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    counted = children.groupBy(child_key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, parents[parent_key] == counted[child_key], "left").select(parents["*"], F.coalesce(name, F.lit(0)).alias(name))


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, bridge_left: str, bridge_right: str, right_key: str, item: Column, name: str) -> DataFrame:
    """Each left row with its distinct related items as an ordered array."""
    links = bridge.select(bridge_left, bridge_right).distinct()
    lists = links.join(right, links[bridge_right] == right[right_key]).groupBy(bridge_left).agg(F.array_sort(F.collect_list(item)).alias(name))
    return left.join(lists, left[left_key] == lists[bridge_left], "left").select(left["*"], F.coalesce(name, F.array().cast(lists.schema[name].dataType)).alias(name))


def paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """nodes: id, parent, label. id, depth, path from the root, of all nodes that hang from a root (parent null).

    Every round joins each open node's upper end to that node's own row, so that paths double: rounds follow the
    logarithm of the depth. A hub above many nodes is one row on the other side of the join.
    """
    rows = cut(nodes.select("id", F.col("parent").alias("above"), F.lit(0).alias("depth"), F.col("label").cast("string").alias("path")))
    n = rows.count()
    while not rows.where("above is not null").isEmpty():
        upper = rows.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        longer = rows.where("above is not null").join(upper, F.col("above") == F.col("_id"))
        longer = longer.select("id", F.col("_above").alias("above"), (F.col("depth") + F.col("_depth") + 1).alias("depth"), F.concat("_path", F.lit(separator), "path").alias("path"))
        # A circle never ends, but its paths outgrow the number of nodes.
        rows = cut(rows.where("above is null").unionByName(longer.where(F.col("depth") < n)))
    return rows.select("id", "depth", "path")


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """id, depth of all nodes below root, itself included, level by level. A circle, or more than MOST_LEVELS levels, is an error."""
    level = cut(nodes.where(F.col("id") == root).select("id", F.lit(0).alias("depth")))
    out, parents = level, nodes.select(F.col("id").alias("_id"), "parent")
    for depth in range(1, MOST_LEVELS + 1):
        level = cut(level.join(parents, F.col("id") == F.col("parent")).select(F.col("_id").alias("id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        if not level.where(F.col("id") == root).isEmpty():  # a circle below the root leads back to it, as a node has one parent
            raise ValueError(f"{root} lies below itself")
        out = out.unionByName(level)
    raise ValueError(f"more than {MOST_LEVELS} levels below {root}")


def components(pairs: DataFrame) -> DataFrame:
    """node, label of the nodes of pairs (a, b): the least node that can be reached, itself included.

    Each round gives every node the least label of its neighbours, and then that label's own label, so that long chains
    halve; a hub's neighbours are pre-aggregated. Rounds end when no label changes.
    """
    edges = cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    labels = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("label", F.col("node")))
    while True:
        named = labels.select(F.col("node").alias("b"), F.col("label").alias("_near"))
        nearest = edges.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        lower = labels.join(nearest, "node", "left").select("node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("_mid"))
        jump = labels.select(F.col("node").alias("_mid"), F.col("label").alias("_far"))
        newer = cut(lower.join(jump, "_mid").select("node", F.least("_mid", "_far").alias("label"), (F.least("_mid", "_far") < F.col("_old")).alias("changed")))
        labels = newer.select("node", "label")
        if newer.where("changed").isEmpty():
            return labels


def pairs_within(df: DataFrame, group: str, member: str) -> DataFrame:
    """All ordered pairs of different members of a group (synonym groups are small by nature)."""
    a, b = df.select(group, F.col(member).alias("a")).distinct(), df.select(group, F.col(member).alias("b")).distinct()
    return a.join(b, group).where("a <> b").select(group, "a", "b")


def missing(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def existing(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def in_order(df: DataFrame, column: str, wanted: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows whose column is in the list, in the list's order."""
    places = F.create_map(*[x for i, w in enumerate(dict.fromkeys(wanted)) for x in (F.lit(w), F.lit(i))])
    return df.where(F.col(column).isin(*wanted)).orderBy(places[F.col(column)], *tie)


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all parts with their tag in column type; missing columns are null; repeats stay."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn("type", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def key_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: added or removed."""
    added = new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def row_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new, change of rows that differ: a full outer join by key."""
    a, b = old.select(F.col(key).alias("ka"), F.col(value).alias("old")), new.select(F.col(key).alias("kb"), F.col(value).alias("new"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full")
    change = F.when(F.col("kb").isNull(), "removed").when(F.col("ka").isNull(), "added").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new")) | F.col("ka").isNull() | F.col("kb").isNull()).select(F.coalesce("ka", "kb").alias(key), "old", "new", change.alias("change"))


# Ordered state.


def serial(df: DataFrame, order: Sequence[str], name: str = "ser_no") -> DataFrame:
    """A serial number over the whole order, without gathering rows in one task: range partitions count their rows,
    and each adds what lies before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # used twice: ranges are sampled anew otherwise
    inside = Window.partitionBy("_part").orderBy(*order)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(before), "_part").withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """before and after: the values of the k rows on either side."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-k, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, k))})


def fill_forward(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    return carried(df, group, [F.asc(c) for c in order], value, name)


def changed(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Whether the value differs from the row before; true for the first row of a group."""
    rows = carried(df, group, [F.asc(c) for c in order], F.struct(F.col(value).alias("v")), "_last", before=True)
    return rows.withColumn(name, F.col("_last").isNull() | ~F.col(value).eqNullSafe(F.col("_last.v"))).drop("_last")


def sort_keys(df: DataFrame, parent: str, order: Sequence[str], name: str = "sort", width: int = 3) -> DataFrame:
    w = Window.partitionBy(parent).orderBy(*order)
    return df.withColumn(name, F.lpad(F.row_number().over(w).cast("string"), width, "0"))


def outline(df: DataFrame, group: str, order: str, depth: str) -> DataFrame:
    """Hierarchical numbers (1, 1.1, 1.2, 2, …) from a stream of depths that grow by at most one, however deep.

    A row's parent is the last row one level above it (an as-of join); rows of one parent are counted, and the counts
    are put together along the tree. order must be unique in its group.
    """
    rows = df.select(group, F.col(order).alias("_at"), F.col(depth).alias("_depth"), (F.col(depth) - 1).alias("_level"))
    above = df.select(group, F.col(order).alias("_up"), F.col(depth).alias("_level"))
    rows = as_of(rows, above.withColumn("_parent", F.col("_up")), [group, "_level"], "_at", "_up", ["_parent"])
    key = lambda at: F.when(F.col(at).isNotNull(), F.struct(group, F.col(at).alias("at")))
    place = F.row_number().over(Window.partitionBy(group, "_depth", "_parent").orderBy("_at"))
    numbers = paths(rows.select(key("_at").alias("id"), key("_parent").alias("parent"), place.alias("label")), ".")
    numbers = numbers.select(F.col(f"id.{group}").alias("_group"), F.col("id.at").alias("_at"), F.col("path").alias("number"))
    return df.join(numbers, df[group].eqNullSafe(F.col("_group")) & (df[order] == F.col("_at")), "left").select(df["*"], "number")


def stable_ids(keys: DataFrame, known: DataFrame, key: str, id_name: str) -> DataFrame:
    """Known ids stay; new keys get one that follows from the key, so that a repeated run gives the same."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    made = F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), digest.substr(13, 4), digest.substr(17, 4), digest.substr(21, 12))
    return keys.select(key).distinct().join(known.select(key, F.col(id_name).alias("_known")), key, "left").select(key, F.coalesce("_known", made).alias(id_name))
