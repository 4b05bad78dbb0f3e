"""Differences between versions of a text."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import remove_puncs, remove_puncs_from

_UNIT = re.compile(r"\[[^\]]*\]|[A-Za-zÀ-ɏḀ-ỿ]+|.", re.S)


def units(s: str) -> list[str]:
    """Bracketed compositions, Latin words, single characters."""
    return _UNIT.findall(s)


FEW = 8


def _rows(a: list[str], b: list[str]):
    """A function from i to the bits of row i: bit k is set if a common subsequence of a[i:] and b[j:], j = len(b) - 1 - k, is
    longer than one of a[i:] and b[j + 1:].

    A row follows from the one below it by a few operations on whole numbers of len(b) bits. Every `step`-th row is kept,
    the rows between are computed anew when they are asked for, from the first to the last: 2 * sqrt(len(a)) rows at once.
    """
    places: dict[str, list[int]] = {}
    common = set(a) & set(b)
    for k, x in enumerate(reversed(b)):
        if x in common:
            places.setdefault(x, []).append(k)
    masks = {x: sum(1 << k for k in at) for x, at in places.items() if len(at) <= FEW and at[-1] < 4096}
    for x, at in places.items():
        if len(at) > FEW:
            bits = np.zeros(at[-1] // 8 + 1, np.uint8)
            np.bitwise_or.at(bits, np.array(at) >> 3, np.uint8(1) << (np.array(at) & 7).astype(np.uint8))
            masks[x] = int.from_bytes(bits.tobytes(), "little")
    full = (1 << len(b)) - 1

    def above(v: int, x: str) -> int:
        """The row (its bits reversed) above v for the unit x."""
        if x not in common:
            return v
        m = masks[x] if x in masks else sum(1 << k for k in places[x])  # rare units of long texts: their masks are not kept
        u = v & m
        return ((v + u) | (v - u)) & full

    step = max(1, int(len(a) ** 0.5))
    v, kept = full, {len(a): full}
    for i in range(len(a) - 1, -1, -1):
        v = above(v, a[i])
        if i % step == 0:
            kept[i] = v
    block: dict[int, int] = {}

    def row(i: int) -> int:
        if i in kept:
            return full & ~kept[i]
        if i not in block:
            top = min(len(a), (i // step + 1) * step)
            block.clear()
            v = kept[top]
            for r in range(top - 1, i // step * step, -1):  # the block's first row is kept
                v = block[r] = above(v, a[r])
        return full & ~block[i]

    return row


def operations(old: str, new: str) -> list[tuple[str, str]]:
    """(kind, unit) along a longest common subsequence of units, kind '', 'del' or 'ins': equal heads are kept, else a deletion
    that loses nothing comes before an insertion.

    Memory is a few rows of bits, so whole books can be compared; time follows the product of the sizes, 64 units at once.
    """
    a, b = units(old or ""), units(new or "")
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    out = [("", x) for x in a[:start]]
    a, b = a[start:], b[start:]
    if not a or not b:
        return out + [("del", x) for x in a] + [("ins", x) for x in b]
    row = _rows(a, b)
    bit = lambda bits, j: (bits >> (len(b) - 1 - j)) & 1
    longest = lambda bits, j: bits.bit_count() - (bits >> (len(b) - j)).bit_count()
    i = j = 0
    while i < len(a) and j < len(b):
        here, under = row(i), row(i + 1)
        length, below = longest(here, j), longest(under, j)  # of what a[i:] and a[i + 1:] have in common with b[j:]
        while j < len(b) and a[i] != b[j] and below < length - bit(here, j):
            length, below = length - bit(here, j), below - bit(under, j)
            out.append(("ins", b[j]))
            j += 1
        if j < len(b):
            same = a[i] == b[j]
            out.append(("" if same else "del", a[i]))
            i, j = i + 1, j + same
    return out + [("del", x) for x in a[i:]] + [("ins", x) for x in b[j:]]


def rendered(ops: Iterable[tuple[str, str]]) -> str:
    """Operations as text with <ins> and <del>, one for each run."""
    out = []
    for kind, run in itertools.groupby(ops, key=lambda x: x[0]):
        text = "".join(x for _, x in run)
        out.append(f"<{kind}>{text}</{kind}>" if kind else text)
    return "".join(out)


def diff(old: str, new: str) -> str:
    """new with <ins> and <del>; deletions come before insertions."""
    return rendered(operations(old, new))


def split_log(old: str, new: str) -> tuple[str, str]:
    """(changes of punctuation, changes of text): the first leads from old to a text between, the second from it to new.

    The text between has the new one's punctuation and the old one's words.
    """
    ops = operations(old, new)
    marks = [(kind, x, bool(x) and not remove_puncs_from(x, space=False)) for kind, x in ops]
    first = [(kind if mark else "", x) for kind, x, mark in marks if mark or kind != "ins"]
    second = [("" if mark else kind, x) for kind, x, mark in marks if not (mark and kind == "del")]
    return rendered(first), rendered(second)


@F.pandas_udf(T.StructType().add("punctuation", T.StringType()).add("text", T.StringType()))
def split_logs(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_log(a, b) for a, b in zip(old, new)], columns=["punctuation", "text"])


@F.pandas_udf(T.StringType())
def diff_html(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff(a, b) for a, b in zip(old, new)])


def tagged_chars(html: Column, tag: str) -> Column:
    """Number of characters inside a tag (what the counts mean, not the number of its spans)."""
    inner = F.regexp_extract_all(html, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.aggregate(F.transform(inner, lambda x: F.length(F.regexp_replace(x, "<[^>]+>", ""))), F.lit(0), lambda a, x: a + x)


def only_punctuation(old: Column, new: Column) -> Column:
    """Whether two different lines differ in ignored characters alone."""
    return (old != new) & (remove_puncs(old, space=False) == remove_puncs(new, space=False))


def state(html: Column, side: str) -> Column:
    """The text before ('ins' is dropped) or after ('del' is) a log's changes; for texts without such tags of their own."""
    gone, kept = ("ins", "del") if side == "before" else ("del", "ins")
    return F.regexp_replace(F.regexp_replace(html, f"(?s)<{gone}>.*?</{gone}>", ""), f"</?{kept}>", "")


def change_logs(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, log (punctuation or text), html: the changes of lines that both versions have, split in two logs to be applied in
    this order; a log without a change has no row."""
    a, b = old.select(F.col(key).alias("ka"), F.col(text).alias("old")), new.select(F.col(key).alias("kb"), F.col(text).alias("new"))
    rows = a.join(b, F.col("ka") == F.col("kb")).where(~F.col("old").eqNullSafe(F.col("new")))
    both = rows.select(F.col("ka").alias(key), split_logs(F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))).alias("s"))
    each = F.explode_outer(F.array(*[F.struct(F.lit(k).alias("log"), F.col(f"s.{k}").alias("html")) for k in ("punctuation", "text")]))
    return both.select(key, each.alias("x")).select(key, "x.*").where(F.col("html").rlike("<(ins|del)>"))


def compare(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, change, html, ins_chars, del_chars, kind of all lines that differ between two versions."""
    a, b = old.select(F.col(key).alias("ka"), F.col(text).alias("old")), new.select(F.col(key).alias("kb"), F.col(text).alias("new"))
    rows = a.join(b, F.col("ka") == F.col("kb"), "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("kb").isNull(), "removed").when(F.col("ka").isNull(), "added").otherwise("changed")
    kind = F.when(F.coalesce(only_punctuation(F.col("old"), F.col("new")), F.lit(False)), "punctuation").otherwise("text")
    out = rows.select(F.coalesce("ka", "kb").alias(key), change.alias("change"), kind.alias("kind"), diff_html("old", "new").alias("html"))
    return out.withColumns({"ins_chars": tagged_chars(F.col("html"), "ins"), "del_chars": tagged_chars(F.col("html"), "del")})
