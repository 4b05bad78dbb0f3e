"""Operator 3: quality rules with adaptive thresholds, in DataFrame functions alone.

Each text is measured once; the measures go to a written table. KLL quantile sketches of each rule's measure are
built for every (language, source), merged to languages and to the whole, and give each group a fence

    q(UPPER) + REACH * max(q(UPPER) - q(MIDDLE), event / size of the text)

in place of a fixed cutoff. A measure is a share, a count over the text's size (characters, words or lines); event is
the count that one occurrence adds to it. So the group's own habits and their spread decide, and where a group shows
no spread, because most of its texts have none of a thing, a text is rejected for more than REACH occurrences beyond
the habit, never for a single one. There is no level of a share that all groups must keep.

A group of fewer than MIN_GROUP texts takes its language's sketch, a language of fewer that of the whole. The fences
are joined to the measures, and a text is kept if it passes the base rules and no measure lies above its group's
fence. Sketches are merged from the partial ones of each task, so a source with a third of all rows is one row for
each task before the shuffle.

Cases: null and empty texts have no words and fail the base rules; null language or source is a group of its own;
repeated rows are measured and judged each; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
MIN_WORDS = 50
MIDDLE, UPPER, REACH = 0.5, 0.9, 3.0
MIN_GROUP = 100  # the upper quantile then has ten texts above it
SKETCH_K = 4096
#: Measure -> (what its text's size is counted in, what one occurrence adds: a repeated window is two of three words).
RULES = {"symbol_share": ("word_chars", 1), "dup_line_share": ("n_lines", 1), "repeat_share": ("n_words", 6), "upper_share": ("word_chars", 1), "bar_share": ("n_words", 1)}


def measures(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the shares that the rules judge."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    step = docs.select(*keep, F.col(text).alias("_t"))
    step = step.withColumn("_w", F.filter(F.split(t, SPACES), lambda w: w != ""))
    step = step.withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: F.length(F.trim(line, F.lit(BLANKS))) > 0))
    # Positions of 3-word windows, sorted behind 33 bits of the window's hash. Windows next to each other with equal
    # bits are compared as text, so a collision of hashes changes nothing.
    low = (1 << 31) - 1
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    step = step.withColumn("_p", F.when(F.size("_w") > 2, F.sort_array(windows)).otherwise(F.array().cast("array<long>")))
    head = lambda x: F.shiftright(x, 31)
    near = lambda x, i: (head(F.get("_p", i + 1)) == head(x)) | (head(F.get("_p", i - 1)) == head(x))
    step = step.withColumn("_c", F.transform(F.filter("_p", lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    named = F.transform("_c", lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("s"), i.alias("i")))
    step = step.withColumn("_c", F.when(F.size("_c") > 0, F.array_sort(named)).otherwise(F.array().cast("array<struct<s:string,i:int>>")))
    same = lambda x, i: (F.get("_c", i + 1)["s"] == x["s"]) | (F.get("_c", i - 1)["s"] == x["s"])
    step = step.withColumn("_q", F.sort_array(F.transform(F.filter("_c", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_q", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_q", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    size = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    out = step.select(
        *[F.col(c) for c in step.columns if c not in ("_t", "_w", "_lines", "_p", "_c", "_q")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        size(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        size(r"[A-Z]+").cast("long").alias("_n_upper"),
        size(r"\|+").cast("long").alias("_n_bars"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_n_upper", "word_chars").alias("upper_share"),
        share("_n_bars", "n_words").alias("bar_share"),
    ).drop("_n_upper", "_n_bars")


def fences(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source) -> the middle and upper quantile of each rule's measure."""
    names = list(RULES)
    sketches = measured.groupBy(F.col(lang).alias("g_lang"), F.col(source).alias("g_source")).agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in names]
    )
    merged = lambda by: [F.sum("n").alias("n"), *[F.kll_merge_agg_double(n, SKETCH_K).alias(n) for n in by]]
    by_lang = sketches.groupBy("g_lang").agg(*merged(names))
    whole = sketches.agg(*merged(names))
    rename = lambda df, mark: df.select([F.col(c).alias(c if c.startswith("g_") else f"{mark}_{c}") for c in df.columns])
    all3 = sketches.join(F.broadcast(rename(whole, "w")))  # one row
    by_lang = rename(by_lang, "l").withColumnRenamed("g_lang", "h_lang")
    all3 = all3.join(by_lang, F.col("g_lang").eqNullSafe(F.col("h_lang")), "left")
    pick = lambda n: F.when(F.col("n") >= MIN_GROUP, F.col(n)).when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{n}")).otherwise(F.col(f"w_{n}"))
    quantile = lambda n, q: F.kll_sketch_get_quantile_double(pick(n), F.lit(q))
    return all3.select("g_lang", "g_source", *[quantile(n, q).alias(f"{n}_{mark}") for n in names for q, mark in ((MIDDLE, "middle"), (UPPER, "upper"))])


def fence(name: str) -> Column:
    size, event = RULES[name]
    middle, upper = F.col(f"{name}_middle"), F.col(f"{name}_upper")
    return upper + REACH * F.greatest(upper - middle, F.lit(event) / F.greatest(F.col(size), F.lit(1)))


def judge(docs: DataFrame, text: str, lang: str, source: str, keep: list[str]) -> DataFrame:
    """keep, the base measures and shares, base_failed, kept: one row for each row of docs."""
    work = Workspace(docs.sparkSession, "quality-rules")
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    measured = work.save(measures(docs, text, [*columns, F.col(lang).alias("m_lang"), F.col(source).alias("m_source")]), "measures")
    limits = work.save(fences(measured, "m_lang", "m_source"), "fences")
    joined = measured.join(limits, F.col("m_lang").eqNullSafe(F.col("g_lang")) & F.col("m_source").eqNullSafe(F.col("g_source")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = ~base_failed
    for n in RULES:
        passed = passed & (F.col(n) <= fence(n))
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), passed.alias("kept"), *RULES,
    )
