"""Operator 2: benchmark decontamination by templates, in DataFrame functions alone.

A text is cut into words and numbers, and each becomes a template token: '#' for a number, '%' for a unit behind a
number, '@' for a capitalised word inside a sentence, else the word in lower case. Windows of WINDOW template tokens
are hashed; the windows of benchmark items are joined to those of documents by hash. Windows of which more than half
are placeholders say too little and are left out. Matches of a document and an item that keep their distance (the same
diagonal) form a passage; it counts if it holds MIN_MATCHES windows, or all windows of an item that has fewer.
For a passage with placeholders the values are compared: one item value must always meet one document value of the
same kind, else the passage is dropped as a chance likeness, unless enough of its windows have no placeholder at all.
So questions that were given other numbers or names are found, and told apart ("reparameterised") from literal ones.

Items that templates can't tell are compared word by word: those of fewer than WINDOW tokens as a whole, if they hold
LEAST_CHARS letters and digits (a single common word is no question), and those with too few windows that are not
mostly placeholders by their literal windows.

The windows of a document that can't be any item's, by a bitmap whose size follows their number up to a bound, are dropped
as soon as they are rows, so that only likely ones are joined or moved. Texts are read once for all kinds of windows. Item windows are broadcast up to BROADCAST_WINDOWS, beyond that Spark joins by shuffle.
The second pass, which needs values, reads only documents with a passage that has placeholders.

Cases: null and empty texts match nothing; items of fewer than LEAST_CHARS letters and digits match nothing; rows of
documents or items that repeat give one row for each (document, item) pair; rows with a null key are left aside, as a
pair can't name them; empty tables give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

WINDOW = 8
MIN_MATCHES = 6
LEAST_CHARS = 12
BROADCAST_WINDOWS = 500_000
LEAST_MAP, MOST_MAP = 1 << 16, 1 << 20  # words of 64 bits in the bitmap of item windows, which has 16 bits for each of them
NAME = "\x02"
#: The units that turn into a placeholder behind a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mi", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "ounces", "pounds", "grams", "kilograms", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "mph", "kmh", "kph", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "kb", "mb", "gb", "tb",
]
_PARTS = rf"(?:[^\p{{L}}\p{{N}}{NAME}.,]|[.,](?!\p{{Nd}})|(?<!\p{{Nd}})[.,])+"
_NAMES = r"(?<=[\p{Ll}\p{Nd}][,;:]? )(?=\p{Lu})"


def _tokens(text: Column) -> Column:
    """Words and numbers; a capitalised word that doesn't begin a sentence has NAME before it."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _NAMES, NAME), _PARTS), lambda w: w != "")


def _is_number(w: Column) -> Column:
    return F.substring(w, 1, 1).between("0", "9")


def _template(tokens: str) -> Column:
    units = F.array(*map(F.lit, UNITS))
    lowered = lambda w: F.lower(w)
    return F.transform(
        tokens,
        lambda w, i: F.when(_is_number(w), F.lit("#"))
        .when(F.startswith(w, F.lit(NAME)), F.lit("@"))
        .when(F.coalesce(_is_number(F.get(tokens, i - 1)), F.lit(False)) & F.array_contains(units, lowered(w)), F.lit("%"))
        .otherwise(lowered(w)),
    )


def _windows(template: str) -> Column:
    """The hash of each window of template tokens."""
    n = F.size(template) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(template, i, WINDOW)))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<long>"))


def _lowered(tokens: str) -> Column:
    return F.transform(tokens, lambda w: F.lower(F.replace(w, F.lit(NAME), F.lit(""))))


def _literal(words: str, width: Column) -> Column:
    """The hash of each window of words, a column of them in lower case, of the given width."""
    n = F.size(words) - (width - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(width, F.slice(words, i, width)))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<long>"))


def _bitmap(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """(the bits of a test of whether a hash may be among n hashes, number of its words)."""
    words = min(MOST_MAP, max(LEAST_MAP, 1 << (max(1, n // 4) - 1).bit_length()))
    word = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(words - 1)).cast("int")
    rows = hashes.select(word.alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = [0] * words
    for r in rows.collect():  # a row for each word at most
        bits[r.word] = r.bits
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>"), words


def _may_hold(bitmap: tuple[Column, int], h: Column) -> Column:
    bits, words = bitmap
    word = F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _likely_windows(templated: DataFrame, widths: list[int], bitmap: tuple[Column, int]) -> DataFrame:
    """id, version, pos, hash of the windows, of templates and of literal widths, that may be an item's: one pass over the texts.

    The explosion is an outer one: Spark infers a filter from the inner one and would push it, with the whole template,
    below. What the bitmap rules out goes right behind it, before anything is joined or moved.
    """
    rows = templated.withColumn("words", _lowered("tokens")) if widths else templated
    arrays = [_windows("template"), *[_literal("words", F.lit(w)) for w in widths]]
    rows = rows.select("id", "version", F.size("tokens").alias("n"), F.posexplode_outer(F.concat(*arrays)).alias("at", "hash")).where(_may_hold(bitmap, F.col("hash")))
    before, pos = F.lit(0), F.col("at")
    for width in [WINDOW, *widths]:  # places count from the start of the array that they are in
        pos = F.when(F.col("at") >= before, F.col("at") - before).otherwise(pos)
        before = before + F.greatest(F.lit(0), F.col("n") - (width - 1))
    return rows.select("id", "version", pos.alias("pos"), "hash")


def _item_windows(bench: DataFrame) -> DataFrame:
    """item, iversion, n_windows, ipos, hash, plain (no placeholder inside), width (of literal windows, else null)."""
    filled = lambda i: F.size(F.filter(F.slice("template", i + 1, WINDOW), lambda t: t.isin("#", "@", "%")))
    told = F.filter(F.transform("windows", lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), filled(i).alias("filled"))), lambda x: x["filled"] <= WINDOW // 2)
    told = F.transform(told, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), (x["filled"] == 0).alias("plain")))
    n = F.size("template")
    enough = F.length(F.regexp_replace(F.array_join("tokens", ""), r"[^\p{L}\p{N}]+", "")) >= LEAST_CHARS
    width = F.when((n < WINDOW) & enough, n).when((n >= WINDOW) & (F.size("_told") < F.least(F.lit(MIN_MATCHES), n - (WINDOW - 1))), F.lit(WINDOW))
    rows = bench.withColumn("_told", told).withColumn("width", width)
    rows = rows.withColumn("words", _lowered("tokens"))
    literal = F.transform(_literal("words", F.col("width")), lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), F.lit(True).alias("plain")))
    rows = rows.withColumn("_own", F.when(F.col("width").isNotNull(), literal).otherwise(F.col("_told")))
    rows = rows.select(F.col("id").alias("item"), F.col("version").alias("iversion"), "width", F.size("_own").alias("n_windows"), F.explode_outer("_own").alias("x"))
    return rows.where(F.col("x").isNotNull()).select("item", "iversion", "n_windows", "width", F.col("x.pos").alias("ipos"), "x.hash", "x.plain")


def _templated(df: DataFrame, key: str, text: str) -> DataFrame:
    step = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("version"), _tokens(F.col(text)).alias("tokens"))
    return step.withColumn("template", _template("tokens"))


def _slots(templated: DataFrame) -> DataFrame:
    """id, version, pos, kind, value of each placeholder."""
    at = templated.select("id", "version", F.posexplode_outer(F.arrays_zip("template", "tokens")).alias("pos", "x"))
    return at.where(F.col("x.template").isin("#", "@", "%")).select("id", "version", "pos", F.col("x.template").alias("kind"), F.lower("x.tokens").alias("value"))


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item_key, n_matched (windows), coverage (share of the item's), n_slots, kind: one row for each leaked pair."""
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    bench = _templated(items, item_key, item_text).dropDuplicates(["id", "version"])
    bench = work.save(bench.withColumn("windows", _windows("template")), "items")
    spread = work.save(_item_windows(bench), "windows")
    n = spread.count()
    small = n <= BROADCAST_WINDOWS
    widths = sorted(r.width for r in spread.where("width is not null").select("width").distinct().collect())  # 1 to WINDOW
    theirs = _likely_windows(_templated(docs, key, text), widths, _bitmap(spread, n))
    met = theirs.join(F.broadcast(spread) if small else spread, "hash")
    group = ["id", "version", "item", "iversion", (F.col("pos") - F.col("ipos")).alias("diagonal")]
    passages = met.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_matched"), F.min("ipos").alias("first"), F.max("ipos").alias("last"), F.first("n_windows").alias("n_windows"), F.sum(F.col("plain").cast("long")).alias("n_plain")
    )
    passages = work.save(passages.where(F.col("n_matched") >= F.least(F.lit(MIN_MATCHES), F.col("n_windows"))), "passages")
    # Values at the placeholders of passages.
    asked = _slots(bench.select("id", "version", "tokens", "template")).select(F.col("id").alias("item"), F.col("version").alias("iversion"), F.col("pos").alias("ipos"), "kind", F.col("value").alias("item_value"))
    asked = passages.join(asked, ["item", "iversion"]).where(F.col("ipos").between(F.col("first"), F.col("last") + (WINDOW - 1)))
    asked = work.save(asked.select("id", "version", "item", "iversion", "diagonal", (F.col("ipos") + F.col("diagonal")).alias("pos"), "kind", "item_value"), "asked")
    if asked.isEmpty():
        judged = passages.withColumns({"n_slots": F.lit(0).cast("long"), "same": F.lit(True), "steady": F.lit(True)})
    else:
        needed = docs.join(asked.select(F.col("id").alias(key)).distinct(), key, "left_semi")
        given = _slots(_templated(needed, key, text).dropDuplicates(["id", "version"])).withColumnRenamed("kind", "given_kind")
        both = asked.join(given, ["id", "version", "pos"], "left")
        at = ["id", "version", "item", "iversion", "diagonal"]
        pairs = both.groupBy(*at, "kind", "item_value").agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.min("value").eqNullSafe(F.max("value")) & F.min(F.col("given_kind").eqNullSafe(F.col("kind"))), F.lit(False)).alias("steady"),
            F.coalesce(F.min(F.col("value").eqNullSafe(F.col("item_value"))), F.lit(False)).alias("same"),
        )
        slots = pairs.groupBy(*at).agg(F.sum("n").alias("n_slots"), F.min("steady").alias("steady"), F.min("same").alias("same"))
        judged = passages.join(slots, at, "left").na.fill({"n_slots": 0, "steady": True, "same": True})
    kept = judged.where(F.col("steady") | (F.col("n_plain") >= F.least(F.lit(MIN_MATCHES), F.col("n_windows")))).groupBy("id", "item").agg(
        F.max("n_matched").alias("n_matched"),
        F.max(F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        F.max(F.struct("n_matched", "n_slots"))["n_slots"].alias("n_slots"),  # of passages of as many windows the most
        F.when(F.max("same"), "literal").otherwise("reparameterised").alias("kind"),
    )
    out = work.save(kept.select(F.col("id").alias(key), F.col("item").alias(item_key), "n_matched", "coverage", "n_slots", "kind"), "leaks")
    work.drop("items", "windows", "passages", "asked")
    return out
