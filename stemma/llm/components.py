"""Connected components by alternating large-star and small-star rounds, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


SMALL = 200_000  # edges up to which a round is one plan: no node's edges can outgrow a task then


def _star(edges: DataFrame, large: bool, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links the neighbours of each node to the smallest of them: those above the node (large) or below it (small).

    The smallest ones are saved, as a join to an aggregate can't be split where a node has very many neighbours.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large" if large else "small")
    near = both.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """links: a, b. Returns node, component (its smallest member) for every node that has a link.

    The rounds end when a pair of stars changes nothing; their number follows the logarithm of the longest path.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    edges = work.save(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, turn = state(edges), 0
    while seen[0]:
        turn += 1
        save = (lambda df, _: df) if seen[0] <= SMALL else (lambda df, table: work.save(df, f"{name}-{table}"))
        edges = work.save(_star(save(_star(edges, True, save), "stars"), False, save), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}", f"{name}-stars", f"{name}-large", f"{name}-small")
        now = state(edges)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(edges.select(F.col("b"), F.col("b")).distinct())
