"""Operator 13: fill-in-the-middle, with cuts at unit borders found by zero-width regexes; DataFrame functions alone.

A unit grammar divides all characters into classes. A class is single (each of its characters is a unit) or a run
(neighbours of that class are one unit). Whether a unit ends between two characters then depends on these two alone, so
a grammar becomes one regex of look-behind and look-ahead that matches the empty places between units, and Spark's
split at it keeps every character. An empty text has no place and no unit; split would give it one piece.

Long texts are split in blocks of at least BLOCK characters, at most BLOCKS of them, each with the first character of
the next one, as borders look no further: so no row holds all pieces of a long text at once. The blocks' numbers of
borders say in which block a cut lies, and only that block's pieces are put together to find its place.

The cuts come from hashes of the key. The output holds each of the three markers once, so the text can be rebuilt
from it and the form alone.

Cases: null and empty texts are of form plain with 0 units; texts that hold a marker stay plain; a null key is hashed as
the empty text; repeated rows give repeated rows; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import bound

BLOCK, BLOCKS = 1024, 64
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Units:
    """A class of characters, as the inside of a regex class without ^, and whether its neighbours are one unit."""

    characters: str
    run: bool = False

    @property
    def one(self) -> str:
        return f"[{self.characters}]"

    @property
    def other(self) -> str:
        return f"[^{self.characters}]"


#: Unit grammars by name. The classes of a grammar don't overlap; what none of them holds is a class of runs.
GRAMMARS: dict[str, Sequence[Units]] = {
    "characters": [Units(r"\s\S")],
    "bytes of ASCII, runs beyond": [Units(r"\x00-\x7F")],
    "words and blanks": [Units(r"\s", run=True)],
    "lines": [Units(r"\n")],
    "words, blanks, signs": [Units(r"\s", run=True), Units(r"\p{L}\p{M}\p{N}_", run=True), Units(r"\p{P}\p{S}")],
}


def border(grammar: Sequence[Units]) -> str:
    """The regex of the places between two units: a change of class, or a single-character class on either side."""
    sides = []
    for u in grammar:
        if u.run:
            sides += [f"(?<={u.one})(?={u.other})", f"(?<={u.other})(?={u.one})"]
        else:
            sides += [f"(?<={u.one})(?={ANY})", f"(?<={ANY})(?={u.one})"]
    return "|".join(dict.fromkeys(sides))


def _pieces(block: Column, regex: str) -> Column:
    return F.split(block, regex, -1)


def _block(text: Column, size: Column, at: Column) -> Column:
    """Block number `at` (from 0) and the character behind it: every border of the text lies inside one of them."""
    return F.substring(text, at * size + 1, size + 1)


def borders(text: Column, length: Column, size: Column, regex: str) -> Column:
    """The number of borders in each block of the text."""
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil((length - 1) / size).cast("int"), F.lit(1)) - 1)
    return F.transform(blocks, lambda at: F.size(_pieces(_block(text, size, at), regex)) - 1)


def _place(text: Column, length: Column, size: Column, counts: Column, units: Column, all_units: Column, regex: str) -> Column:
    """The number of characters of the first `units` units."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("before"), F.lit(False).alias("found"))

    def step(s: Column, n: Column) -> Column:
        return F.when(s["found"] | (s["before"] + n >= units), F.struct(s["at"].alias("at"), s["before"].alias("before"), F.lit(True).alias("found"))).otherwise(
            F.struct((s["at"] + 1).alias("at"), (s["before"] + n).alias("before"), F.lit(False).alias("found"))
        )

    def inside(s: Column) -> Column:
        mine = F.slice(_pieces(_block(text, size, s["at"]), regex), F.lit(1), (units - s["before"]).cast("int"))
        return s["at"] * size + F.length(F.array_join(mine, ""))

    found = bound(F.aggregate(counts, zero, step), inside)
    return F.when(units <= 0, F.lit(0)).when(units >= all_units, length).otherwise(found).cast("int")


def _number(hexed: Column, group: int) -> Column:
    """The group-th 8-digit group of a hexadecimal text, as a number."""
    return F.conv(F.substring(hexed, 8 * (group - 1) + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, key: str, text: str, *, grammar: str | Sequence[Units] = "characters", seed: str = "1", percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")
) -> DataFrame:
    """key, text, n (units), form, prefix, middle, suffix (null if plain), output: a row for each row of docs.

    percent of the texts are cut, spm_percent of these put the suffix first. markers: before prefix, suffix, middle.
    """
    if any(a[:i] == b[-i:] for a in markers for b in markers for i in range(1, min(len(a), len(b)))) or len(set(markers)) < 3 or any(a != b and a in b for a in markers for b in markers) or not all(markers):
        raise ValueError("markers must be different, and none may begin as one ends or lie inside one")
    regex = border(GRAMMARS[grammar] if isinstance(grammar, str) else grammar)
    p, s, m = map(F.lit, markers)
    step = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    step = step.withColumns({"_hex": hexed, "_length": F.length("text")})
    step = step.withColumn("_size", F.greatest(F.lit(BLOCK), F.ceil(F.col("_length") / BLOCKS).cast("int")))
    step = step.withColumn("_borders", borders(F.col("text"), F.col("_length"), F.col("_size"), regex))
    units = F.when(F.col("_length") > 0, F.aggregate("_borders", F.lit(0), lambda a, x: a + x) + 1).otherwise(F.lit(0))
    step = step.withColumn("n", units.cast("long"))
    plain = (F.col("n") == 0) | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (_number(F.col("_hex"), 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_number(F.col("_hex"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [_number(F.col("_hex"), k) % (F.col("n") + 1) for k in (1, 2)]
    step = step.withColumns({"form": form, "_a": F.least(*cuts), "_b": F.greatest(*cuts)})
    place = lambda c: _place(F.col("text"), F.col("_length"), F.col("_size"), F.col("_borders"), F.col(c), F.col("n"), regex)
    step = step.withColumns({c: F.when(F.col("form") != "plain", place(c)) for c in ("_a", "_b")})
    part = lambda start, stop: F.substring("text", start + 1, stop - start)
    step = step.withColumns({"prefix": part(F.lit(0), F.col("_a")), "middle": part(F.col("_a"), F.col("_b")), "suffix": part(F.col("_b"), F.col("_length"))})
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("text"))
    )
    return step.select(F.col("key").alias(key), "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of that form was made of."""
    places: Mapping[str, Column] = {m: F.instr(output, F.lit(m)) for m in markers}
    p, s, m = markers
    behind = lambda x: places[x] + len(x)
    between = lambda x, y: F.substring(output, behind(x), places[y] - behind(x))
    last = F.substring(output, behind(m), F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), last, between(s, m))).when(form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output)


def digests(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(docs, key, text, **options)
    back = restored(F.col("output"), F.col("form"), options.get("markers", ("<P>", "<S>", "<M>")))
    return made.select(
        key, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
