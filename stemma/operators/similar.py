"""Similar passages: overlapping chunks, candidate choice, local alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.text import quoted

BLOCK = 50


def chunks(docs: DataFrame, key: str, content: str, block: int = BLOCK) -> DataFrame:
    """key, chunk, tag, content: two neighbouring blocks each; the last block stands alone only if it is the only one."""
    blocks = F.regexp_extract_all(F.col(content), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))  # one pass over the text
    cut = docs.select(key, blocks.alias("_b")).withColumn("_n", F.greatest(F.size("_b") - 1, F.lit(1)))
    joined = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.concat(F.get("_b", i), F.coalesce(F.get("_b", i + 1), F.lit(""))))
    rows = cut.select(key, "_n", F.posexplode_outer(joined).alias("chunk", "content")).where(F.col("content").isNotNull())
    tag = F.when(F.col("chunk") == F.col("_n") - 1, "end").when(F.col("chunk") == 0, "start").otherwise("middle")
    return rows.select(key, "chunk", tag.alias("tag"), "content")


def candidates(rows: DataFrame, content: str, query: str, k: int = 500, share: float = 0.5, tie: tuple[str, ...] = ()) -> DataFrame:
    """The k rows with the most of the query's bigrams, of those that have the given share of its characters."""
    chars = list(dict.fromkeys(query.replace(" ", "")))
    wanted = list(dict.fromkeys(query[i : i + 2] for i in range(len(query) - 1)))
    some = lambda found, of: F.size(F.array_intersect(found, F.array(*map(F.lit, of)).cast("array<string>")))  # noqa: E731  whatever the query's length
    pairs = F.when(F.length(content) > 1, F.transform(F.sequence(F.lit(1), F.length(content) - 1), lambda i: F.substring(content, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    held = rows.where(some(F.split(content, ""), chars) >= share * len(chars))
    return held.withColumn("rank_score", some(pairs, wanted)).orderBy(F.desc("rank_score"), *tie).limit(k)


def ranked(rows: DataFrame, key: str, content: str, words: Sequence[str], k: int = 500, share: float = 0.5) -> DataFrame:
    """key, lcs, bm25: the k rows that match the query best, of those that hold the share of its words.

    Proximity comes first: the longest run of the query's words, in its order, that stands in the text. Rows of one
    run go by BM25 without length: each word's weight log((N - n + 1) / n) by the number n of rows that hold it, half
    as much for the second and later occurrences. Word counts take one pass; rows and weights are one row.
    """
    words = list(words)
    distinct = list(dict.fromkeys(words))
    text = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\s+", " "), F.lit(" "))
    times = lambda w: F.size(F.split(text, "(?= " + quoted(w) + " )")) - 1
    counted = rows.select(key, text.alias("_text"), F.array(*[times(w) for w in distinct]).alias("_tf"))
    n = counted.agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.count_if(F.get("_tf", F.lit(i)) > 0) for i in range(len(distinct))]).alias("_df"))
    weight = F.transform("_df", lambda d: F.greatest(F.lit(0.0), F.log((F.col("_n") - d + 1) / F.greatest(d, F.lit(1)))))
    held = F.size(F.filter("_tf", lambda x: x > 0))
    runs = [(j - i, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    lcs = F.greatest(F.lit(0), F.lit(0), *[F.when(F.contains("_text", F.lit(f" {run} ")), size).otherwise(0) for size, run in runs])
    scored = counted.where(held >= share * len(distinct)).join(F.broadcast(n.select(weight.alias("_w"))))
    bm25 = F.aggregate(F.zip_with("_tf", "_w", lambda t, w: t * 2.2 / (t + 1.2) * w), F.lit(0.0), lambda a, x: a + x)
    return scored.select(key, lcs.alias("lcs"), bm25.alias("bm25")).orderBy(F.desc("lcs"), F.desc("bm25"), key).limit(k)


def rendered(a: str, b: str, gain: int = 2, penalty: int = -1) -> str:
    """b as aligned with a: equal characters in <mark>, others of the aligned stretch in <del> (inside <mark> where they
    stand for one of a), and outside of it those that a holds anywhere in <em>."""
    paint = lambda s: "".join(f"<em>{c}</em>" if c in a else c for c in s)
    path = alignment(a, b, gain, penalty)
    if not path:
        return paint(b)
    out, before = [paint(b[: path[0][1] - 1])], None
    for i, j in path:
        c = b[j - 1]
        step = None if before is None else (i - before[0], j - before[1])
        if step == (0, 1):  # a character of b alone
            out.append(f"<del>{c}</del>" if i < len(a) else c)
        elif step != (1, 0):
            out.append(f"<mark>{c}</mark>" if a[i - 1] == c else f"<mark><del>{c}</del></mark>")
        before = (i, j)
    return "".join([*out, paint(b[path[-1][1] :])]).replace("</mark><mark>", "")


def _matrix(a: str, b: str, gain: int, penalty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.array(list(a)), np.array(list(b))
    m = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    steps = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.maximum(0, np.maximum(m[i - 1, :-1] + np.where(y == x[i - 1], gain, penalty), m[i - 1, 1:] + penalty))
        full = np.r_[0, row]
        # A gap along the row loses the same at each step, so it is a running maximum of value plus steps.
        m[i] = np.maximum.accumulate(full - penalty * steps) + penalty * steps
    return m, x, y


def alignment(a: str, b: str, gain: int = 2, penalty: int = -1) -> list[tuple[int, int]]:
    """The places (from 1) of a best local alignment, from its start.

    Of equal best cells the later one counts. The way back goes to the largest of the three neighbours, the diagonal
    first, then the cell above, then the left one, until a zero.
    """
    if not a or not b:
        return []
    return _path(_matrix(a, b, gain, penalty)[0], len(b))


def _path(m: np.ndarray, width: int) -> list[tuple[int, int]]:
    i, j = divmod(int(m.size - 1 - np.argmax(m.ravel()[::-1])), width + 1)
    path = []
    while m[i, j] > 0:
        path.append((i, j))
        near = (m[i - 1, j - 1], m[i - 1, j], m[i, j - 1])
        i, j = ((i - 1, j - 1), (i - 1, j), (i, j - 1))[int(np.argmax(near))]
    return path[::-1]


def smith_waterman(a: str, b: str, gain: int = 2, penalty: int = -1) -> tuple[int, str]:
    """(score, b from the first to the last aligned place with equal stretches marked)."""
    if not a or not b:
        return 0, b
    m, x, y = _matrix(a, b, gain, penalty)
    path = _path(m, len(b))
    if not path:
        return 0, b
    first, last = path[0][1], path[-1][1]
    equal = {q for p, q in path if x[p - 1] == y[q - 1]}
    out, on = [], False
    for q in range(first, last + 1):
        if (q in equal) != on:
            out.append("</mark>" if on else "<mark>")
            on = not on
        out.append(b[q - 1])
    return int(m.max()), b[: first - 1] + "".join(out) + ("</mark>" if on else "") + b[last:]


@F.pandas_udf(T.StructType().add("score", T.IntegerType()).add("highlight", T.StringType()))
def align(query: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([smith_waterman(q or "", t or "") for q, t in zip(query, text)], columns=["score", "highlight"])


align = align.asNondeterministic()  # else a filter on its score runs it a second time


def similar(rows: DataFrame, key: str, content: str, query: str, k: int = 500, least: int = 16) -> DataFrame:
    """Chunks like the query but without it, by falling score; of neighbouring chunks with one marked text the first.

    A match that touches its chunk's edge is dropped, except at the start or end of the text.
    """
    found = candidates(rows, content, query, k, tie=(key, "chunk")).where(~F.contains(F.col(content), F.lit(query)))
    found = found.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a limit leaves one partition
    found = found.withColumn("a", align(F.lit(query), F.col(content))).select(key, "chunk", "tag", content, "a.score", "a.highlight").where(F.col("score") >= least)
    inside = (~F.startswith("highlight", F.lit("<mark>")) | ((F.col("tag") == "start") | (F.col("chunk") == 0))) & (~F.endswith("highlight", F.lit("</mark>")) | (F.col("tag") == "end"))
    marked = F.array_join(F.regexp_extract_all("highlight", F.lit("<mark>(.*?)</mark>"), F.lit(1)), "")
    found = found.where(inside).withColumn("_marked", marked)
    w = Window.partitionBy(key, "_marked").orderBy("chunk")
    return found.withColumn("_near", F.col("chunk") - F.lag("chunk").over(w)).where("_near is null or _near > 1").drop("_near", "_marked").orderBy(F.desc("score"), key, "chunk")
