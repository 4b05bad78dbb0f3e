"""Texts with tagged spans as DocuXML documents.

Spans may overlap, elements may not: where a span ends that others were opened in, those are closed before it and opened
again behind it, so that every character keeps its tags and the output parses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
SPANS = "array<struct<start:int,stop:int,tag:string,attributes:map<string,string>>>"


def _clean(s: str) -> str:
    return escape(_NOT_XML.sub("", s))


def nested(text: str, spans: Sequence[tuple[int, int, str, Sequence[tuple[str, str]]]]) -> str:
    """The text with spans (start, stop, tag, attributes) as elements; at one place what ends comes before what starts, and of
    what starts the longer first. Spans are cut to the text; one without length is an empty element."""
    size = len(text)
    cut = [(max(0, a), min(size, b), tag, attributes) for a, b, tag, attributes in spans if a <= size and b >= 0 and a <= b]
    starts: dict[int, list[int]] = {}
    for k, (a, b, _, _) in sorted(enumerate(cut), key=lambda x: (-x[1][1], x[0])):
        starts.setdefault(a, []).append(k)
    ends = {b for a, b, _, _ in cut if b > a}
    head = lambda k: cut[k][2] + "".join(f" {n}={quoteattr(_NOT_XML.sub('', v))}" for n, v in cut[k][3])
    out, opened, at = [], [], 0
    for place in sorted({*starts, *ends}):
        out.append(_clean(text[at:place]))
        at = place
        deepest = next((i for i, k in enumerate(opened) if cut[k][1] == place), None)
        if deepest is not None:
            closed, opened = opened[deepest:], opened[:deepest]
            out += [f"</{cut[k][2]}>" for k in reversed(closed)]
            for k in closed:
                if cut[k][1] > place:
                    out.append(f"<{head(k)}>")
                    opened.append(k)
        for k in starts.get(place, []):
            if cut[k][1] == place:
                out.append(f"<{head(k)}/>")
            else:
                out.append(f"<{head(k)}>")
                opened.append(k)
    return "".join([*out, _clean(text[at:])])


def documents(texts: DataFrame, name: str, content: str, spans: str, metadata: Sequence[str] = ()) -> DataFrame:
    """name, xml: one document for each row, its columns of metadata as elements that are left out where null."""
    rows = texts.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"), F.col(spans).cast(SPANS).alias("spans"), *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(metadata)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, held, *values in zip(*[c.to_pylist() for c in batch.columns]):
                marked = nested(text or "", [(s["start"], s["stop"], s["tag"], s["attributes"] or []) for s in held or []])
                about = "".join(f"<{m}>{_clean(v)}</{m}>" for m, v in zip(metadata, values) if v is not None)
                out.append(f"<document filename={quoteattr(_NOT_XML.sub('', key or ''))}>{about}<doc_content>{marked}</doc_content></document>")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["name", "xml"])

    return rows.mapInArrow(run, "name string, xml string").withColumnRenamed("name", name)


def exports(documents: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """group, xml: the documents (with a column xml) of each group, a work, in one export."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "xml"))), lambda x: x["xml"]), "")
    head, foot = '<?xml version="1.0" encoding="UTF-8"?><ThdlPrototypeExport><documents>', "</documents></ThdlPrototypeExport>"
    return documents.groupBy(group).agg(F.concat(F.lit(head), inner, F.lit(foot)).alias("xml"))
