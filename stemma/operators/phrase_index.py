"""A stored text index: the places of character pairs, by which phrases are found without reading texts.

The index holds, for each field of each text, every pair of neighbouring characters with its places (from 1 on; the
last character is paired with END). A phrase is covered by pairs two characters apart, the last one by the pair that
ends it; it stands where all of them do, shifted by their distance. So places are exact, and no text is read for them.

    <path>/postings/canon=…/generation=…/field=…/bucket=…   pair, keys, sizes, gaps; sorted by pair
    <path>/texts/canon=…/generation=…/part=…                all columns of the texts; sorted by key
    <path>/manifest                                         the live generation of each canon, and the shape of the index

A pair's hash is its bucket, a folder, so that a query reads its pairs' buckets alone, and of their files the row groups
of these pairs. A pair's places in a block of texts of one canon, some SLICE characters, are one row: the texts' keys, the
number of places in each, and the places as gaps in bytes of seven bits. Pairs of common letters are spread over blocks,
and rebalancing deals the rows of a large bucket to several files.

Texts are written first, in PARTS by their order, and postings made of a few parts at a time, so that what is shuffled at
once is a share of the whole; it is deleted with each write. A canon is replaced by writing a new generation of it;
readers see it when the manifest is swapped, and the old one is deleted after that.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.arrays import bound
from ..plans import qlang
from ..plans.cut import cut
from ..sources import sinks
from . import endpoints, kwic, search

END = "\U0010ffff"  # no character
BUCKETS = 64
SLICE = 1 << 20
PARTS = 8
#: Characters of which postings are made at once, or a share of 1 / PARTS of all, if that is more.
ROUND = 1 << 25
_SHIFT = np.uint64(21)


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each) of positive numbers: seven bits a byte, lowest first, all but the last byte marked."""
    sizes = 1 + sum((numbers >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        held = sizes > k
        out[starts[held] + k] = ((numbers[held] >> (7 * k)) & 127) | np.where(sizes[held] > k + 1, 128, 0)
    return out, sizes


def _unpacked(coded: np.ndarray) -> np.ndarray:
    if not len(coded):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, coded[:-1] < 128])
    at = np.arange(len(coded)) - np.repeat(starts, np.diff(np.r_[starts, len(coded)]))
    return np.add.reduceat((coded & 127).astype(np.int64) << (7 * at), starts)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows of about SLICE in all."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        yield start, stop
        start = stop


def _pairs_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each distinct pair: itself, where its texts begin, then these texts (rows), their numbers of places, and its gaps."""
    whole = [t + END for t in texts.to_pylist()]
    points = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in whole], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(whole)), sizes)
    first = np.ones(len(points), bool)
    first[starts + sizes - 1] = False  # END begins no pair
    at = np.flatnonzero(first)
    codes = (points[at] << _SHIFT) | points[at + 1]
    order = np.argsort(codes, kind="stable")  # by pairs, their texts and places
    codes, at = codes[order], at[order]
    owner, places = owner[at], at - starts[owner[at]] + 1
    new_pair = np.r_[True, codes[1:] != codes[:-1]][: len(codes)]
    new_text = new_pair | np.r_[True, owner[1:] != owner[:-1]][: len(codes)]
    coded, widths = _packed(np.where(new_text, places, places - np.r_[0, places[:-1]][: len(places)]))
    heads, texts_at = np.flatnonzero(new_pair), np.flatnonzero(new_text)
    both = np.stack([codes[heads] >> _SHIFT, codes[heads] & np.uint64((1 << 21) - 1)], axis=1).astype("<u4")
    said = both.tobytes().decode("utf-32-le")
    cuts = np.r_[0, np.cumsum(widths)][np.r_[heads, len(codes)]].astype(np.int32)
    gaps = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts), pa.py_buffer(coded)])
    return [said[i : i + 2] for i in range(0, len(said), 2)], np.searchsorted(texts_at, np.r_[heads, len(codes)]), owner[texts_at], np.diff(np.r_[texts_at, len(codes)]), gaps


def _postings(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Of docs: canon, key and the fields."""
    names = ["canon", "field", "pair", "keys", "sizes", "gaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canons = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            for mine in (np.flatnonzero(canons == c) for c in np.unique(canons)):
                canon, key = batch.column(0)[int(mine[0])].as_py(), batch.column(1).take(pa.array(mine))
                for i, field in enumerate(fields):
                    texts = pc.fill_null(batch.column(2 + i).cast(pa.string()), "").take(pa.array(mine))
                    for start, stop in _slices(pc.utf8_length(texts).to_numpy(zero_copy_only=False)):
                        pairs, heads, who, sizes, gaps = _pairs_of(texts.slice(start, stop - start))
                        listed = lambda values: pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), values)  # noqa: B023, E731
                        columns = [pa.array([canon] * len(pairs), pa.string()), pa.array([field] * len(pairs), pa.string()), pa.array(pairs, pa.string())]
                        yield pa.RecordBatch.from_arrays([*columns, listed(key.take(pa.array(who + start))), listed(pa.array(sizes.astype(np.int32))), gaps], names)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"canon string, field string, pair string, keys array<{kind}>, sizes array<int>, gaps binary")


def _spread(blocks: DataFrame, rest: Sequence[str] = ()) -> DataFrame:
    """pair, key, places, and the rest, of pair, keys, sizes, gaps and the rest: a row for each text."""
    names = ["pair", "key", "places", *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)):
                rows = batch.slice(start, stop - start)
                counts = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = pa.array(np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(1)).to_numpy(zero_copy_only=False)))
                sums = np.cumsum(gaps := _unpacked(np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8)))
                ends = np.cumsum(counts)
                first = ends - counts
                places = (sums - np.repeat(sums[first] - gaps[first], counts)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(places))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(owner), rows.column(1).flatten(), listed, *[rows.column(4 + i).take(owner) for i in range(len(rest))]], names)

    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}
    made = ["pair string", f"key {blocks.schema['keys'].dataType.elementType.simpleString()}", "places array<int>", *[f"{c} {kind[c]}" for c in rest]]
    return blocks.select("pair", "keys", "sizes", "gaps", *rest).mapInArrow(run, ", ".join(made))


@contextlib.contextmanager
def _dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query inside has shuffled is deleted when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _bucket(pair: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, key: str, fields: Sequence[str], canon: str | None = None, buckets: int = BUCKETS) -> "TextIndex":
    """Indexes the fields (searchable texts) of docs, whose key is unique; canons that docs has rows of are replaced.

    A first build makes the index; later ones must have the same fields and buckets.
    """
    spark = docs.sparkSession
    shape = {"key": key, "fields": list(fields), "buckets": buckets, "schema": docs.schema.jsonValue()}
    live = _manifest(spark, path)
    if live is not None and {k: live[k] for k in shape} != shape:
        raise ValueError("the index has another shape")
    generation = uuid.uuid4().hex[:12]
    name = (F.col(canon).cast("string") if canon else F.lit("all")).alias("canon")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"), name).withColumn("generation", F.lit(generation))
    part = F.least(F.floor(F.spark_partition_id() * PARTS / n), F.lit(PARTS - 1)).cast("int")
    chars, size = Observation(), sum((F.coalesce(F.length(F.col("row")[f].cast("string")), F.lit(0)) for f in fields), F.lit(0).cast("long"))
    dealt = columns.repartitionByRange(n, "canon", "_key").withColumn("part", part).observe(chars, F.sum(size).alias("n")).sortWithinPartitions("canon", "_key").drop("_key")
    with _dropped_shuffles(spark):
        names = [r[0] for r in docs.select(name).distinct().collect()]  # a folder each
        dealt.write.mode("append").option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy("canon", "generation", "part").parquet(f"{path}/texts")
        kept = spark.read.schema(T.StructType([*dealt.schema])).parquet(f"{path}/texts").where(F.col("generation") == generation)
        where = ["canon", "generation", "field", "bucket"]
        rounds = min(PARTS, max(1, -(-(chars.get["n"] or 0) // ROUND)))
        for i in range(rounds):
            texts = kept.where(F.col("part").isin([p for p in range(PARTS) if p * rounds // PARTS == i])).select("canon", F.col("row")[key].alias("key"), *[F.col("row")[f].alias(f"f{k}") for k, f in enumerate(fields)])
            found = _postings(texts, fields).withColumn("generation", F.lit(generation)).withColumn("bucket", _bucket(F.col("pair"), buckets))
            found = found.hint("rebalance", *where).sortWithinPartitions(*where, "pair", F.col("keys")[0])
            found.write.mode("append").option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy(*where).parquet(f"{path}/postings")
    before = dict(map(tuple, live["canons"])) if live else {}
    gone = [(c, before[c]) for c in names if c in before]
    sinks_manifest = shape | {"canons": sorted((before | {c: generation for c in names}).items(), key=lambda x: (x[0] is None, x[0] or ""))}
    staged = f"{path}/manifest-{generation}"
    spark.createDataFrame([(json.dumps(sinks_manifest),)], "value string").coalesce(1).write.text(staged)
    sinks.publish(spark, staged, f"{path}/manifest")
    for c, old in gone:
        for table in ("postings", "texts"):
            sinks.delete(spark, f"{path}/{table}/canon={'__HIVE_DEFAULT_PARTITION__' if c is None else sinks.escaped(spark, c)}/generation={old}")
    return TextIndex(spark, path)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0]) if sinks.exists(spark, f"{path}/manifest") else None


def cover(phrase: str) -> list[tuple[str, int]]:
    """(pair, distance from the phrase's start) of pairs that hold all its characters."""
    at = sorted({*range(0, len(phrase) - 1, 2), len(phrase) - 2})
    return [(phrase[i : i + 2], i) for i in at]


def shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by) if by else places


def overlaps_itself(phrase: str) -> bool:
    return any(phrase.startswith(phrase[i:]) for i in range(1, len(phrase)))


class _OfPlaces:
    """The query's questions, answered by columns of places."""

    def __init__(self, places: Mapping[str, Column]):
        self.places = places

    def holds(self, q: str) -> Column:
        return F.size(self.places[q]) > 0

    def hits(self, q: str) -> Column:
        """Places that don't overlap."""
        at = self.places[q]
        if not overlaps_itself(q):
            return F.size(at).cast("long")
        start = F.struct(F.lit(-len(q)).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.when(p >= a["last"] + len(q), F.struct(p.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
        return F.aggregate(at, start, step, lambda a: a["n"])


def _shown(parts: Sequence, of: _OfPlaces) -> Column:
    """The number of places that endpoints.concordance() shows for an AND's parts, without those of its NEAR chains."""
    out, plain = F.lit(0), {}
    for part in parts:
        if isinstance(part, qlang.Exclude):
            longer = shifted(of.places[part.longer], -part.longer.index(part.phrase))
            out = out + F.size(F.array_except(of.places[part.phrase], longer))
        elif not isinstance(part, qlang.Near):
            plain |= dict.fromkeys(qlang.phrases(part))
    return sum((F.size(of.places[q]) for q in plain), out).cast("long")


class TextIndex:
    """A view of the index as it was when opened: files are listed once for all queries through it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        shape = _manifest(spark, path)
        if shape is None:
            raise ValueError(f"{path} holds no index")
        self.key, self.fields, self.buckets = shape["key"], shape["fields"], shape["buckets"]
        self.live = [(c, g) for c, g in shape["canons"]]
        row = T.StructType.fromJson(shape["schema"])
        kind = row[self.key].dataType
        parts = T.StructType().add("canon", "string").add("generation", "string")
        postings = T.StructType().add("pair", "string").add("keys", T.ArrayType(kind)).add("sizes", T.ArrayType(T.IntegerType())).add("gaps", "binary")
        postings = T.StructType([*postings, *parts]).add("field", "string").add("bucket", "integer")
        self._postings = spark.read.schema(postings).parquet(f"{path}/postings")
        self._texts = spark.read.schema(T.StructType([T.StructField("row", row), *parts])).parquet(f"{path}/texts")

    def _live(self, canons: Sequence[str] | None) -> Column:
        """On partition columns alone: what is replaced or not asked for isn't read."""
        wanted = [f"{c or ''}/{g}" for c, g in self.live if canons is None or c in canons]
        return F.concat(F.coalesce("canon", F.lit("")), F.lit("/"), "generation").isin(wanted)

    def texts(self, canons: Sequence[str] | None = None) -> DataFrame:
        return self._texts.where(self._live(canons)).select("row.*")

    def blocks(self) -> DataFrame:
        """Every live row as it is stored: pair, keys, sizes, gaps, canon, field."""
        return self._postings.where(self._live(None)).select("pair", "keys", "sizes", "gaps", "canon", "field")

    def rows(self) -> DataFrame:
        """pair, key, places, canon, field of every text's pairs."""
        return _spread(self.blocks(), ["canon", "field"])

    def read(self, key, offset: int, size: int, field: str | None = None) -> DataFrame:
        """One text's characters from offset (0 is the first) on."""
        return self.texts().where(F.col(self.key) == key).select(self.key, F.substring(field or self.fields[0], offset + 1, size).alias("text"))

    def postings(self, phrases: Sequence[str], field: str | None = None, canons: Sequence[str] | None = None) -> DataFrame:
        """The rows of the phrases' pairs: only their buckets are read. A phrase of one character has pairs in all buckets."""
        pairs = sorted({p for q in phrases if len(q) > 1 for p, _ in cover(q)})
        singles = sorted({q for q in phrases if len(q) == 1})
        wanted = reduce(lambda a, b: a | b, [F.startswith("pair", F.lit(c)) for c in singles], F.col("pair").isin(pairs) if pairs else F.lit(False))
        rows = self._postings.where(self._live(canons) & (F.col("field") == (field or self.fields[0])))
        if not singles:
            numbers = self.spark.range(1).select([_bucket(F.lit(p), self.buckets) for p in pairs]).first()
            rows = rows.where(F.col("bucket").isin(sorted(set(numbers))))
        return _spread(rows.where(wanted)).select("key", "pair", "places")

    def places(self, phrases: Sequence[str], field: str | None = None, canons: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
        """(key and one column for each phrase, the columns: places from 1 on, rising) of texts that hold a pair of them."""
        phrases = list(dict.fromkeys(phrases))
        each = self.postings(phrases, field, canons).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pair", "places"))).alias("_m"))
        none = F.array().cast("array<int>")

        def of(q: str) -> Column:
            if len(q) == 1:
                return F.array_sort(F.flatten(F.map_values(F.map_filter("_m", lambda k, _: F.startswith(k, F.lit(q))))))
            return F.coalesce(reduce(F.array_intersect, [shifted(F.col("_m")[p], at) for p, at in cover(q)]), none)

        names = {q: f"_p{i}" for i, q in enumerate(phrases)}
        found = each.select(F.col("key").alias(self.key), *[of(q).alias(n) for q, n in names.items()])
        return found, {q: F.col(n) for q, n in names.items()}

    def match(self, query: str, field: str | None = None, canons: Sequence[str] | None = None) -> DataFrame:
        """key and term_hits of the texts that match, as search.match() gives them."""
        tree = qlang.parse(query)
        return self._counted(tree, lambda of: qlang.hit_count(tree, of), qlang.near_parts(tree), field, canons)

    def _counted(self, tree, count: Callable[[_OfPlaces], Column], counted: Sequence[qlang.Near], field: str | None, canons: Sequence[str] | None) -> DataFrame:
        """key and term_hits of the texts that match: the count of what they hold, and the tuples of the chains in counted."""
        nears = qlang.near_parts(tree)
        found, places = self.places(qlang.mentioned(tree), field, canons)
        if qlang.matches_nothing_held(tree):  # texts without any of the pairs have no row
            every = self.texts(canons).select(F.col(self.key).alias("_every"))
            none = F.array().cast("array<int>")
            found = every.join(found, F.col("_every").eqNullSafe(F.col(self.key)), "left").select(F.col("_every").alias(self.key), *[F.coalesce(c, none).alias(n) for c, n in ((p, f"_p{i}") for i, p in enumerate(places.values()))])
        of = _OfPlaces(places)
        held = found.where(qlang.predicate(tree, of))
        rows = held.select(self.key, count(of).alias("term_hits"))
        for near in nears:
            tuples = kwic.drop_contained(self._chain(held, places, near), near.terms)
            each = tuples.groupBy(F.col(self.key).alias("_key")).agg(F.count(F.lit(1)).alias("_tuples"))
            rows = rows.join(each, F.col(self.key) == F.col("_key")).drop("_key")
            rows = rows.withColumn("term_hits", F.col("term_hits") + (F.col("_tuples") if near in counted else F.lit(0))).drop("_tuples")
        return rows.select(self.key, "term_hits")

    def _chain(self, rows: DataFrame, places: Mapping[str, Column], near: qlang.Near) -> DataFrame:
        return kwic.chain(lambda t, name: rows.select(self.key, F.explode(places[t]).alias(name)), self.key, near.terms, near.gaps)

    def near(self, terms: Sequence[str], gaps: Sequence[int], field: str | None = None, canons: Sequence[str] | None = None) -> DataFrame:
        """key, p1, p2, …, as kwic.near() gives them."""
        found, places = self.places(terms, field, canons)
        of = _OfPlaces(places)
        return self._chain(found.where(reduce(lambda a, b: a & b, [of.holds(t) for t in dict.fromkeys(terms)])), places, qlang.Near(tuple(terms), tuple(gaps)))

    def with_attributes(self, found: DataFrame, columns: Sequence[str], canons: Sequence[str] | None = None) -> DataFrame:
        """found with further columns of its texts; texts themselves are read only if they are among them."""
        known = self.texts(canons).select(F.col(self.key).alias("_key"), *columns)
        return found.join(known, found[self.key].eqNullSafe(F.col("_key"))).drop("_key")

    def occurrences(self, keywords: str | Sequence[str], around: int = 20, field: str | None = None, canons: Sequence[str] | None = None, keys: Sequence | None = None) -> DataFrame:
        """key, keyword, pos, left, right, as kwic.occurrences() gives them; of the texts in keys (a page's) alone, if given."""
        words = list(dict.fromkeys(keywords.split(",") if isinstance(keywords, str) else keywords))
        field = field or self.fields[0]
        found, places = self.places(words, field, canons)
        of = _OfPlaces(places)
        found = found.where(reduce(lambda a, b: a | b, map(of.holds, words)))
        texts = self.texts(canons)
        if keys is not None:
            found, texts = found.where(F.col(self.key).isin(list(keys))), texts.where(F.col(self.key).isin(list(keys)))
        rows = texts.select(F.col(self.key).alias("_key"), F.col(field).alias("_text")).join(found, F.col("_key").eqNullSafe(F.col(self.key)))
        shown = bound(F.col("_text"), lambda c: kwic.with_contexts(c, places, around))
        return rows.select(self.key, F.explode_outer(shown).alias("o")).where(F.col("o").isNotNull()).select(self.key, "o.*")

    def all_in_one(
        self, query: str, columns: Sequence[str] = (), order: str = "", tie: Sequence[str] = (), start: int = 0, rows: int = 20, around: int = 20, facets: Sequence[str] = (), field: str | None = None, canons: Sequence[str] | None = None
    ) -> endpoints.Answer:
        """As endpoints.all_in_one(): the page's texts alone are read, by their keys; for NEAR and exclusion, too, whose
        places are counted in the index.
        """
        tree = qlang.parse(query)
        parts = tree.parts if isinstance(tree, qlang.And) else (tree,)
        nears = [p for p in parts if isinstance(p, qlang.Near)]
        settled = nears or any(isinstance(p, qlang.Exclude) for p in parts)
        if settled:
            found = self._counted(tree, lambda of: _shown(parts, of), nears, field, canons).where((F.col("term_hits") > 0) & F.col(self.key).isNotNull())
        else:
            found = self.match(query, field, canons)
        by = [x.strip().rstrip("+-") for x in order.split(",")]
        wanted = [c for c in dict.fromkeys([*columns, *facets, *by, *tie]) if c not in ("", "term_hits", self.key)]
        found = cut(self.with_attributes(found, wanted, canons) if wanted else found)  # read for the page, the totals and each facet
        totals, bundle = search.totals(found), search.facet_bundle(found, facets) if facets else None
        ordered = [*tie, self.key]
        page = search.page(search.order(found, order, ordered), start, rows)
        keys = [r[0] for r in page.select(self.key).collect()]  # `rows` of them at most
        if settled:
            texts = self.texts(canons).where(F.col(self.key).isin(keys))
            return endpoints.Answer(endpoints.all_in_one(texts, self.key, field or self.fields[0], query, order, tie, 0, rows, around).results, totals, bundle)
        places = self.occurrences(qlang.phrases(tree), around, field, canons, keys)
        shown = F.struct("pos", "keyword", "left", F.concat(F.lit("<mark>"), "keyword", F.lit("</mark>")).alias("mark"), "right")
        lists = places.groupBy(F.col(self.key).alias("_key")).agg(F.array_sort(F.collect_list(shown)).alias("kwics"))
        results = found.where(F.col(self.key).isin(keys)).join(lists, F.col(self.key) == F.col("_key")).drop("_key")
        return endpoints.Answer(search.order(results, order, ordered), totals, bundle)

    def spelling_hits(self, spellings: Sequence[str], field: str | None = None, canons: Sequence[str] | None = None) -> DataFrame:
        """spelling, hits of those that occur, as expand.spelling_hits() gives them."""
        found, places = self.places(spellings, field, canons)
        of = _OfPlaces(places)
        each = F.array(*[F.struct(F.lit(q).alias("spelling"), of.hits(q).alias("hits")) for q in places])
        rows = found.select(F.explode(each).alias("x")).select("x.*")
        return rows.groupBy("spelling").agg(F.sum("hits").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "spelling")
