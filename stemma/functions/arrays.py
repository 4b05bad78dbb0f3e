"""Folds over arrays that keep what they pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 256


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a fold over items gives out on its way, as one array of type kind.

    step(state, item) gives the next state and an array to append. An array that grows by one element at a time costs
    its square, so it grows inside blocks, and the blocks are put together.
    """
    none = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["o"], out).alias("o"))

    def block(acc: Column, chunk: Column) -> Column:
        done = lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o"))
        return F.aggregate(chunk, F.struct(acc["s"].alias("s"), none.alias("o")), one, done)

    def whole(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        out = F.aggregate(chunks, F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("o")), block, lambda r: F.flatten(r["o"]))
        return F.when(F.size(xs) > 0, out).otherwise(none)

    return bound(items, whole)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside a lambda an expression from outside is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
