"""TEI XML to rows: text by fascicle, lines with notes, table of contents, fascicle ends, notes, reading HTML.

Each transform walks a parsed document once, in a Python UDTF-like mapInArrow: a document is one row, and rows are
dealt out by Spark. The walk keeps the current fascicle and line, as milestones and line breaks come between text.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normal

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
SKIPPED = {"teiHeader", "rdg", "mulu", "docNumber", "charDecl"}
BLOCKS = {"p", "head", "lg", "l", "item", "byline", "dialog", "juan", "div", "list", "table", "row", "cell"}


# How documents name the forms of rare characters, and the ids of those that belong to scripts of their own.
MAPPINGS = {"unicode": "uni", "normal_unicode": "norm_uni"}
PROPERTIES = {"composition": "composition", "normalized form|Normalized Unicode": "norm_big5", "rjchar|Character in the Siddham font": "symbol", "Romanized form in Unicode transcription": "romanized"}
OWN_SCRIPTS = ("SD", "RJ")
UNKNOWN_GLYPH = "◇"


def in_line(note: ET.Element) -> bool:
    """Whether a note belongs to the running text."""
    return note.get("place") in ("inline", "inline2", "interlinear") or note.get("type") == "authorial"


def aside(e: ET.Element) -> bool:
    """Whether an element is a note that stands in parentheses; one of the author's own is plain text."""
    return _name(e) == "note" and e.get("type") != "authorial"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


class Walk:
    """One pass over a document: on_text(kind, text) gets every stretch of text that readers see, in order."""

    def __init__(self, xml: str, glyphs: dict[str, str | dict[str, str]] | None = None):
        self.root = ET.fromstring(xml)
        self.glyphs = {**self._own_glyphs(), **(glyphs or {})}
        self.juan, self.lb, self.note = 1, "", 0
        self.stack: list[ET.Element] = []
        text = next((e for e in self.root.iter() if _name(e) == "text"), None)
        self.normal = [text is None or text.get("behaviour") != "no-norm"]  # the innermost text or term decides

    def _own_glyphs(self) -> dict[str, dict[str, str]]:
        """The forms of the characters that the document declares."""
        out = {}
        for char in self.root.iter():
            if _name(char) != "char":
                continue
            forms: dict[str, str] = {}
            for e in char.iter():
                if _name(e) == "mapping" and (kind := MAPPINGS.get(e.get("type", "unicode"))):
                    forms[kind] = self._code(e.text or "")
                if _name(e) == "charProp":
                    parts = {_name(x): (x.text or "") for x in e}
                    kind = next((k for pattern, k in PROPERTIES.items() if re.fullmatch(pattern, parts.get("localName", ""))), None)
                    if kind and parts.get("value"):
                        forms.setdefault(kind, parts["value"])
            out[char.get(XML_ID, "")] = forms
        return out

    def glyph(self, e: ET.Element) -> str:
        """A rare character's form: of scripts of their own the symbol, then the romanised form; of others its Unicode
        character, where normal forms may stand for it these, and then its composition. An unknown one is named."""
        gid = e.get("ref", "").lstrip("#")
        forms = self.glyphs.get(gid)
        if not isinstance(forms, dict):
            return forms or UNKNOWN_GLYPH
        if gid.startswith(OWN_SCRIPTS):
            order = ("symbol", "romanized")
        else:
            order = ("uni", *(("norm_uni", "norm_big5") if self.normal[-1] else ()), "composition")
        return next((forms[k] for k in order if forms.get(k)), UNKNOWN_GLYPH if gid.startswith(OWN_SCRIPTS) else f"[{gid}]")

    @staticmethod
    def _code(s: str) -> str:
        m = re.fullmatch(r"U\+([0-9A-F]+)", s.strip())
        return chr(int(m[1], 16)) if m else s.strip()

    def run(self) -> None:
        body = next((e for e in self.root.iter() if _name(e) == "body"), self.root)
        self._visit(body)

    def _visit(self, e: ET.Element) -> None:
        tag = _name(e)
        self.stack.append(e)
        if tag == "milestone" and e.get("unit") == "juan":
            self.juan = int(re.sub(r"\D", "", e.get("n", "")) or self.juan)
            self.on_juan(e)
        elif tag == "lb" and e.get("type") != "old":
            self.lb = e.get("n", "")
            self.on_line(e)
        elif tag == "g":
            self.on_text(self.glyph(e), e)
        elif tag == "mulu":
            self.on_mulu(e)
        elif tag == "note" and not in_line(e):
            self.on_note(e)
        elif tag == "unclear" and not len(e) and not e.text:
            self.on_text("▆", e)
        elif tag not in SKIPPED:
            scoped = tag in ("term", "text")
            if scoped:
                self.normal.append(e.get("behaviour") != "no-norm")
            self.on_open(e)
            self._content(e)
            self.on_close(e)
            if scoped:
                self.normal.pop()
        self.stack.pop()

    def _content(self, e: ET.Element) -> None:
        if e.text:
            self.on_text(e.text.replace("\n", ""), e)
        for child in e:
            self._visit(child)
            if child.tail:
                self.on_text(child.tail.replace("\n", ""), e)

    def inside(self, tag: str, **attributes: str) -> bool:
        return any(_name(x) == tag and all(x.get(k) == v for k, v in attributes.items()) for x in self.stack)

    def on_juan(self, e): ...
    def on_line(self, e): ...
    def on_text(self, s, e): ...
    def on_mulu(self, e): ...
    def on_note(self, e): ...
    def on_open(self, e): ...
    def on_close(self, e): ...


class SearchText(Walk):
    """juan, text, text_without_notes: notes inside lines stand in parentheses in the first."""

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.full: dict[int, list[str]] = {}
        self.bare: dict[int, list[str]] = {}

    def on_text(self, s, e):
        self.full.setdefault(self.juan, []).append(s)
        if not self.inside("note"):
            self.bare.setdefault(self.juan, []).append(s)

    def on_open(self, e):
        if aside(e):
            self.full.setdefault(self.juan, []).append("(")

    def on_close(self, e):
        if aside(e):
            self.full.setdefault(self.juan, []).append(")")

    def rows(self):
        self.run()
        return [(j, "".join(t), "".join(self.bare.get(j, []))) for j, t in sorted(self.full.items())]


class Lines(Walk):
    """juan, lb, html, notes (JSON of note number to text): one row for each printed line."""

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.out: list[list] = []

    def on_line(self, e):
        self.out.append([self.juan, self.lb, [], {}])

    def on_text(self, s, e):
        if self.out and s:
            self.out[-1][2].append(html.escape(s, quote=False))

    def on_note(self, e):
        self.note += 1
        if self.out:
            n = e.get("n") or str(self.note)
            self.out[-1][3][n] = "".join(e.itertext()).strip()
            self.out[-1][2].append(f'<a class="note" href="#n{n}"></a>')

    def rows(self):
        self.run()
        return [(j, lb, "".join(h), json.dumps(n, ensure_ascii=False) if n else None) for j, lb, h, n in self.out]


class Contents(Walk):
    """n, parent, label, juan, lb: the entries of the table of contents, numbered by their level."""

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.counts: list[int] = []
        self.out: list[tuple] = []

    def on_mulu(self, e):
        level = int(e.get("level", "0") or 0)
        if level < 1:
            return
        self.counts = [*self.counts[:level], *[0] * (level - len(self.counts))]
        self.counts[level - 1] += 1
        number = ".".join(map(str, self.counts[:level]))
        label = "".join(self.glyphs.get(x.get("ref", "").lstrip("#"), "") if _name(x) == "g" else (x.text or "") for x in e.iter()).strip()
        self.out.append((number, number.rpartition(".")[0] or None, label, self.juan, self.lb))

    def rows(self):
        self.run()
        return self.out


class JuanEnds(Walk):
    """juan, lb_begin, lb_end."""

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.ends: dict[int, list[str]] = {}

    def on_line(self, e):
        self.ends.setdefault(self.juan, [self.lb, self.lb])[1] = self.lb

    def rows(self):
        self.run()
        return [(j, *x) for j, x in sorted(self.ends.items())]


class Notes(Walk):
    """juan, lb, n, place, content, prefix, suffix; inline notes with up to 100 characters on either side."""

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.text, self.size = [], 0
        self.out: list[tuple] = []
        self.open: list[tuple] = []

    def on_text(self, s, e):
        self.text.append(s)
        self.size += len(s)

    def on_note(self, e):
        self.note += 1
        place = "foot" if (e.get("place") or "").startswith("foot") else "add" if e.get("type") == "add" else e.get("type") or "foot"
        self.out.append((self.juan, self.lb, e.get("n") or str(self.note), place, "".join(e.itertext()).strip(), self.size, self.size))

    def on_open(self, e):
        if _name(e) == "note":
            self.note += 1
            self.open.append((self.juan, self.lb, e.get("n") or str(self.note), self.size))

    def on_close(self, e):
        if _name(e) == "note":
            j, lb, n, start = self.open.pop()
            self.out.append((j, lb, n, "inline", None, start, self.size))

    def rows(self):
        self.run()
        text = "".join(self.text)
        inline = lambda x: x[3] == "inline"
        return [(*x[:4], text[x[5] : x[6]] if inline(x) else x[4], text[max(0, x[5] - 100) : x[5]] if inline(x) else None, text[x[6] : x[6] + 100] if inline(x) else None) for x in self.out]


class ReadingHtml(Walk):
    """juan, html: blocks, line anchors, rare characters and notes as markup."""

    TAGS = {"p": "p", "head": "h2", "byline": "p", "lg": "div", "l": "span", "list": "ul", "item": "li", "table": "table", "row": "tr", "cell": "td", "div": "div", "juan": "p", "note": "span"}

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.parts: dict[int, list[str]] = {}
        self.notes: dict[int, list[str]] = {}

    def _put(self, s: str) -> None:
        self.parts.setdefault(self.juan, []).append(s)

    def on_line(self, e):
        self._put(f'<a class="lb" id="{self.lb}"></a>')

    def on_text(self, s, e):
        text = html.escape(s, quote=False)
        self._put(f'<span class="gaiji">{text}</span>' if _name(e) == "g" else text)

    def on_note(self, e):
        self.note += 1
        n = e.get("n") or str(self.note)
        self._put(f'<a class="noteAnchor" href="#n{n}"></a>')
        self.notes.setdefault(self.juan, []).append(f'<div class="note" id="n{n}">{html.escape("".join(e.itertext()).strip(), quote=False)}</div>')

    def on_open(self, e):
        if (tag := self.TAGS.get(_name(e))) is not None:
            self._put(f'<{tag} class="{_name(e)}">' + ("(" if aside(e) else ""))

    def on_close(self, e):
        if (tag := self.TAGS.get(_name(e))) is not None:
            self._put((")" if aside(e) else "") + f"</{tag}>")

    def rows(self):
        self.run()
        return [(j, "".join(p) + "".join(self.notes.get(j, []))) for j, p in sorted(self.parts.items())]


class NotedHtml(ReadingHtml):
    """juan, html, notes (JSON), missing: reading HTML whose notes are resolved.

    The first pass collects what notes can be referred to: original and modified ones by number. A modified note takes the
    place of the original of its number (or of its number without the letter that parts of one note have), so that one is
    not shown. The second pass puts an anchor for every shown note, added notes under numbers of their own, and one for
    every star, which refers to an earlier note once more and is counted. The foot of a fascicle lists its notes with
    the places that refer to them; what refers to nothing is listed as missing.
    """

    LABELS = {"biao": "標", "jie": "解", "ke": "科"}

    def __init__(self, xml, glyphs=None):
        super().__init__(xml, glyphs)
        self.targets: dict[str, ET.Element] = {}
        self.modified: set[str] = set()
        for e in self.root.iter():
            if _name(e) != "note":
                continue
            n = e.get("n", "")
            if e.get("type") == "mod":
                self.modified |= {n, re.sub(r"[a-z]$", "", n)}
                self.targets[n] = e
            elif e.get("type") == "orig":
                self.targets.setdefault(n, e)
        self.stars: dict[str, int] = {}
        self.added: dict[int, int] = {}
        self.listed: dict[int, dict[str, dict]] = {}
        self.missing: dict[int, list[str]] = {}

    def _foot(self, e: ET.Element) -> str:
        """A note's own text: of readings the preferred one, notes inside it in parentheses if they belong to its text."""
        out = [e.text or ""]
        for child in e:
            tag = _name(child)
            if tag == "g":
                out.append(self.glyph(child))
            elif tag == "app":
                out += [self._foot(x) for x in child if _name(x) == "lem"]
            elif tag == "note":
                inner = self._foot(child) if in_line(child) else ""
                out.append(inner if child.get("type") == "authorial" or not inner else f"({inner})")
            elif tag == "unclear":
                out.append(self._foot(child) or "▆")
            elif tag != "rdg":
                out.append(self._foot(child))
            out.append(child.tail or "")
        return "".join(out).replace("\n", "").strip()

    def _cited(self, e: ET.Element) -> str:
        """The parallels of an added note: notes of type cf1, cf2, … in the preferred reading right behind it."""
        beside = list(self.stack[-2]) if len(self.stack) > 1 else []
        behind = next((y for x, y in zip(beside, beside[1:]) if x is e), None)
        if behind is None or _name(behind) != "app" or not e.get("n") or behind.get("n") != e.get("n"):
            return ""
        lem = next((x for x in behind if _name(x) == "lem"), None)
        cited = [self._foot(x) for x in (lem if lem is not None else []) if _name(x) == "note" and re.fullmatch(r"cf\d+", x.get("type", ""))]
        return f"(cf. {'; '.join(cited)})" if cited else ""

    def _refer(self, name: str, kind: str, text: str, **more: str) -> None:
        note = self.listed.setdefault(self.juan, {}).setdefault(name, {"id": name, "kind": kind, "text": text, "refs": []})
        place = f"ref-{name}-{len(note['refs']) + 1}"
        note["refs"].append(place)
        extra = "".join(f' {k.replace("_", "-")}="{html.escape(v)}"' for k, v in more.items())
        self._put(f'<a class="noteAnchor{"" if kind in ("orig", "mod") and "data_star_no" not in more else " star" if "data_star_no" in more else " add"}" id="{place}" href="#{name}"{extra}></a>')

    def _star(self, e: ET.Element) -> None:
        n = e.get("corresp", "").lstrip("#")
        if n not in self.targets:
            self.missing.setdefault(self.juan, []).append(n)
            return
        self.stars[n] = self.stars.get(n, 0) + 1
        number = re.sub(r"\D", "", n)[-3:].lstrip("0") or "0"
        self._refer(f"n{n}", self.targets[n].get("type", ""), self._foot(self.targets[n]), data_star_no=f"{number}-{self.stars[n]}")

    def on_note(self, e):
        kind, n = e.get("type", ""), e.get("n", "")
        if e.get("rend") == "hide" or kind in ("equivalent", "rest") or kind.startswith("cf"):
            return
        if kind == "add":
            self.added[self.juan] = self.added.get(self.juan, 0) + 1
            self._refer(f"a{self.juan}-{self.added[self.juan]}", kind, self._foot(e) + self._cited(e))
        elif kind == "star":
            self._star(e)
        elif kind == "mod" or kind == "orig" and n not in self.modified:
            label = self.LABELS.get(e.get("subtype", ""))
            self._refer(f"n{n}", kind, self._foot(e), **({"data_label": label + n[-2:]} if label and kind == "orig" else {}))
        elif kind not in ("orig", "mod"):
            self.note += 1
            self._refer(f"n{n or self.note}", "orig", self._foot(e))

    def on_open(self, e):
        if _name(e) == "app" and e.get("type") == "star":
            self._star(e)
        super().on_open(e)

    def rows(self):
        self.run()
        out = []
        for j, parts in sorted(self.parts.items()):
            notes = list(self.listed.get(j, {}).values())
            foot = ['<div class="note" id="%s">%s%s</div>' % (x["id"], html.escape(x["text"], quote=False), "".join(f'<a class="back" href="#{r}"></a>' for r in x["refs"])) for x in notes]
            out.append((j, "".join([*parts, *foot]), json.dumps(notes, ensure_ascii=False), ",".join(self.missing.get(j, []))))
        return out


class Editions(Walk):
    """juan, edition, html: the text of every edition of a file in one pass, each with anchors at its own lines.

    The editions are those that line breaks name. In an apparatus an edition has the first reading that names its
    witness, else the preferred one. witnesses: the witness of each edition, its own name unless given.
    """

    def __init__(self, xml, glyphs=None, witnesses: dict[str, str] | None = None):
        super().__init__(xml, glyphs)
        names = dict.fromkeys(e.get("ed", "") for e in self.root.iter() if _name(e) == "lb" and e.get("type") != "old")
        self.witnesses = {n: (witnesses or {}).get(n, n).lstrip("#") for n in names} or {"": ""}
        self.active = [set(self.witnesses)]
        self.parts: dict[tuple[int, str], list[str]] = {}

    def _put(self, s: str, editions: set[str]) -> None:
        for n in editions:
            self.parts.setdefault((self.juan, n), []).append(s)

    def _visit(self, e):
        if _name(e) != "app":
            return super()._visit(e)
        readings, taken = [], set()
        for x in e:
            if _name(x) == "rdg":
                own = {n for n in self.active[-1] - taken if self.witnesses[n] in re.findall(r"[^\s#]+", x.get("wit", ""))}
                readings.append((x, own))
                taken |= own
        for x in e:
            of = self.active[-1] - taken if _name(x) == "lem" else next((o for r, o in readings if r is x), set())
            if of:
                self.active.append(of)
                self._content(x)
                self.active.pop()

    def on_line(self, e):
        self._put(f'<a id="lb{self.lb}"></a>', {e.get("ed", "")} & self.active[-1])

    def on_text(self, s, e):
        self._put(html.escape(s, quote=False), self.active[-1])

    def on_open(self, e):
        if aside(e):
            self._put("(", self.active[-1])

    def on_close(self, e):
        if aside(e):
            self._put(")", self.active[-1])

    def rows(self):
        self.run()
        return [(j, n, "".join(p)) for (j, n), p in sorted(self.parts.items())]


class PlainText(Walk):
    """juan, text for download: a line for each block, notes in parentheses or left out."""

    def __init__(self, xml, glyphs=None, notes: bool = True):
        super().__init__(xml, glyphs)
        self.keep = notes
        self.parts: dict[int, list[str]] = {}

    def on_text(self, s, e):
        if self.keep or not self.inside("note"):
            self.parts.setdefault(self.juan, []).append(s)

    def on_open(self, e):
        if aside(e) and self.keep:
            self.parts.setdefault(self.juan, []).append("(")

    def on_close(self, e):
        if aside(e) and self.keep:
            self.parts.setdefault(self.juan, []).append(")")
        elif _name(e) in BLOCKS:
            self.parts.setdefault(self.juan, []).append("\n")

    def rows(self):
        self.run()
        return [(j, re.sub(r"\n{2,}", "\n", "".join(p)).strip("\n")) for j, p in sorted(self.parts.items())]


TRANSFORMS: dict[str, tuple[Callable, str]] = {
    "search_text": (SearchText, "juan int, text string, text_without_notes string"),
    "lines": (Lines, "juan int, lb string, html string, notes string"),
    "contents": (Contents, "n string, parent string, label string, juan int, lb string"),
    "juan_ends": (JuanEnds, "juan int, lb_begin string, lb_end string"),
    "notes": (Notes, "juan int, lb string, n string, place string, content string, prefix string, suffix string"),
    "reading_html": (ReadingHtml, "juan int, html string"),
    "noted_html": (NotedHtml, "juan int, html string, notes string, missing string"),
    "editions": (Editions, "juan int, edition string, html string"),
    "plain_text": (PlainText, "juan int, text string"),
}


def transform(files: DataFrame, name: str, glyphs: dict[str, str | dict[str, str]] | None = None, **options) -> DataFrame:
    """files: file, content. The rows of the named transform, each with its file.

    glyphs: of rare characters the one form to show, or their forms (uni, norm_uni, norm_big5, composition, symbol, romanized).
    """
    make, schema = TRANSFORMS[name]
    kinds = {"int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *r) for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for r in make(c, glyphs, **options).rows()]
            columns = list(zip(*rows)) or [[]] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, kinds[k]) for c, (_, k) in zip(columns[1:], fields)]], ["file", *[n for n, _ in fields]])

    return files.select("file", "content").mapInArrow(run, f"file string, {schema}")


# Further forms, made from the rows of the transforms above.


def _bare(markup: Column) -> Column:
    """Text of a line's markup."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return out


def text_for_diff(lines: DataFrame) -> DataFrame:
    """file, lb, text of lines(): without markup, note marks, blanks and punctuation, so that versions differ in words alone."""
    return lines.select("file", "lb", F.regexp_replace(normal(_bare(F.col("html"))), r"\s+", "").alias("text")).where("text <> ''")


def concordance_html(lines: DataFrame) -> DataFrame:
    """file, juan, html of lines(): every line behind an anchor with its number, without other markup."""
    line = F.concat(F.lit('<a id="lb'), "lb", F.lit('"></a>'), F.regexp_replace("html", "<[^>]*>", ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lb", line.alias("line")))), lambda x: x["line"])
    return lines.groupBy("file", "juan").agg(F.array_join(parts, "").alias("html"))


def index_text(texts: DataFrame) -> DataFrame:
    """file, juan, text of search_text(): the form that is searched, with notes."""
    return texts.select("file", "juan", normal(F.col("text")).alias("text"))


def download_page(reading: DataFrame, titles: DataFrame) -> DataFrame:
    """file, juan, html of reading_html() as a page of its own; titles: file, title."""
    title = F.coalesce(F.col("title"), F.col("file"))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(c), F.lit(entity))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"))
    return reading.join(titles, "file", "left").select("file", "juan", F.concat(head, "html", F.lit("</body></html>")).alias("html"))


def catalog(xml: str) -> list[tuple]:
    """(n, parent, label, work, sort) of a nested catalog: elements are nodes, attributes n, label, work."""
    out: list[tuple] = []

    def visit(e: ET.Element, parent: str | None) -> None:
        for i, child in enumerate(e, start=1):
            n = child.get("n") or f"{parent or 'root'}.{i:03d}"
            out.append((n, parent, child.get("label") or (child.text or "").strip(), child.get("work"), f"{i:03d}"))
            visit(child, n)

    visit(ET.fromstring(xml), None)
    return out
