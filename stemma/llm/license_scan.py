"""Operator 7: license scans by ordered signature rules, in DataFrame functions alone.

A text is reduced to its words (runs of ASCII letters and digits and of all other characters beyond ASCII) in lower
case, joined by one blank. A text that holds no gate keyword has no detection. Otherwise the rules whose own keyword
it holds are run, each regex over the whole text, and every match is a span. A span is suppressed if a span of higher
priority holds it, or one of the same priority that is longer or comes from an earlier rule; spans that merely
overlap stay. Everything happens inside the row: no shuffle and no join. Places, in characters and in words, are summed
up along the gaps between matches, so work follows the size of the text and the number of matches.

Cases: null and empty texts have no words and no detections; repeated rows give repeated rows; a row's other columns
are left aside; positions are null where nothing is found.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import running
from .license_rules import BASE, GATE, KINDS, rules

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "array<struct<start:int,back:int,rank:int,rule:int,label:string,score:double,word:int,words:int>>"


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(text: str, rule: Column) -> Column:
    """Spans of one rule's matches, as SPAN: back and rank are negative, so that outer and stronger spans sort first."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, word = at["char"] + F.length(x["gap"]), at["word"] + _blanks(x["gap"])
        stop, last = start + F.length(x["hit"]), word + _blanks(x["hit"])
        span = F.struct(
            start.alias("start"), (-stop).alias("back"), (-rule["priority"]).alias("rank"), rule["order"].alias("rule"),
            rule["label"].alias("label"), rule["score"].alias("score"), word.alias("word"), (last - word + 1).alias("words"),
        )
        return F.struct(stop.alias("char"), last.alias("word")), F.array(span)

    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    pairs = F.zip_with(F.split(text, rule["pattern"], -1), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())  # the last gap has no match behind it
    return running(pairs, F.struct(F.lit(0).alias("char"), F.lit(0).alias("word")), step, SPAN)


def _table(rows: list) -> Column:
    """The rules as one literal: a JSON text is far cheaper to hand over than thousands of literal columns."""
    text = json.dumps([r._asdict() for r in rows])
    return F.from_json(F.lit(text), "array<struct<order:int,keyword:string,priority:int,score:double,label:string,pattern:string>>")


def _unsuppressed(spans: str) -> Column:
    """One pass over spans by (start, end descending, priority descending, rule), with each priority's furthest end."""
    tiers = sorted({p for p, _ in KINDS.values()})
    zero = F.struct(*[F.lit(-1).alias(f"t{p}") for p in tiers])

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        end, own = -x["back"], -x["rank"]
        hidden = reduce(lambda a, b: a | b, [(F.lit(p) >= own) & (state[f"t{p}"] >= end) for p in tiers])
        later = [F.when(own == p, F.greatest(state[f"t{p}"], end)).otherwise(state[f"t{p}"]).alias(f"t{p}") for p in tiers]
        return F.struct(*later), F.when(hidden, F.array().cast(SPAN)).otherwise(F.array(x))

    return running(F.array_sort(spans), zero, step, SPAN)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, base (array of first word index, label), found (array of first word, words, label, score, rule)."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NOT_WORD, " "), F.lit(" "))
    step = docs.select(F.col(key).alias("key"), words.alias("_n"))
    n_words = F.when(F.col("_n") == "", 0).otherwise(_blanks(F.col("_n")) + 1)
    step = step.select("key", n_words.cast("long").alias("n_words"), "_n", F.lower("_n").alias("_l"))
    gate = reduce(lambda a, b: a | b, [F.contains("_l", F.lit(k)) for k in GATE])
    # The text in lower case by A to Z alone, and only where a rule may match.
    step = step.select("key", "n_words", F.when(gate, F.translate("_n", UPPER, LOWER)).alias("_x"))
    all_rules = rules()
    keywords = list(dict.fromkeys(r.keyword for r in all_rules))
    held = F.filter(F.array(*[F.when(F.contains("_x", F.lit(k)), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    step = step.withColumn("_k", F.when(F.col("_x").isNotNull(), held))
    spans = F.flatten(F.transform(F.filter(_table(all_rules), lambda r: F.array_contains("_k", r["keyword"])), lambda r: _spans("_x", r)))
    step = step.withColumn("_s", F.when(F.size("_k") > 0, spans).otherwise(F.array().cast(SPAN)))
    base_rules = [type(all_rules[0])(i, "licen", 0, 0.6, label, rf"(?<![^ ]){phrase}(?![^ ])") for i, (phrase, label) in enumerate(BASE.items())]
    base = F.flatten(F.transform(_table(base_rules), lambda r: _spans("_x", r)))
    step = step.withColumn("_b", F.when(F.array_contains("_k", "licen"), base).otherwise(F.array().cast(SPAN)))
    step = step.withColumn("_s", F.when(F.size("_s") > 1, _unsuppressed("_s")).otherwise(F.col("_s")))
    return step.select(
        "key",
        "n_words",
        F.transform("_b", lambda x: F.struct(x["word"].cast("long").alias("word"), x["label"].alias("label"))).alias("base"),
        F.transform("_s", lambda x: F.struct(x["word"].cast("long").alias("word"), x["words"].cast("long").alias("words"), x["label"].alias("label"), x["score"].alias("score"), x["rule"].alias("rule"))).alias("found"),
    ).withColumnRenamed("key", key)


def report(scanned: DataFrame, key: str) -> DataFrame:
    """One row for each document: counts, first and last base place, labels and score."""
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    base = F.transform("base", lambda x: x["label"])
    found = F.transform("found", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["word"])
    best = F.array_max(F.concat(F.transform("found", lambda x: x["score"]), F.transform("base", lambda x: F.lit(0.6))))
    return scanned.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, found).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
