"""The query language: phrases with AND (blank), OR (|), NOT (!), NEAR/k, exclusion (-) and quorum (/n).

parse() gives a tree; predicate() and hit_count() compile it to Columns over searchable text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.text import hits, normal_query


class QueryError(ValueError):
    """A query that can't be run; code is the status an API would give."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    gaps: tuple[int, ...]


@dataclass(frozen=True)
class Exclude:
    """Places of phrase that are not part of the longer phrase."""

    phrase: str
    longer: str


@dataclass(frozen=True)
class Quorum:
    parts: tuple[str, ...]
    least: float  # a number of parts, or below 1 a share of them


_TOKEN = re.compile(r'\s*(?:"((?:\\.|[^"\\])*)"|(NEAR/(\d+))|([|!()-])|/(\d*\.?\d+)|([^\s"|!()]+))')


def _tokens(q: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(q.rstrip()):
        m = _TOKEN.match(q, at)
        if not m:
            raise QueryError(f"can't read the query at {q[at:]!r}")
        if m[1] is not None:
            out.append(("phrase", re.sub(r"\\(.)", r"\1", m[1])))
        elif m[2]:
            out.append(("near", m[3]))
        elif m[4]:
            out.append((m[4], m[4]))
        elif m[5]:
            out.append(("quorum", m[5]))
        else:
            out.append(("phrase", re.sub(r"\\(.)", r"\1", m[6])))
        at = m.end()
    return out


def parse(q: str):
    tokens = _tokens(q)
    if not tokens:
        raise QueryError("the query is empty")
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1][1]

    def either():
        parts = [both()]
        while peek() == "|":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both():
        parts = [unary()]
        while peek() in ("phrase", "!", "(", "-"):
            if peek() == "-":
                take()
                longer = normal_query(take())
                if not isinstance(parts[-1], Phrase) or parts[-1].text not in longer:
                    raise QueryError("the excluded phrase must hold the one searched for")
                parts[-1] = Exclude(parts[-1].text, longer)
            else:
                parts.append(unary())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary():
        if peek() == "!":
            take()
            return Not(unary())
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise QueryError("a parenthesis is open")
            take()
            return inner
        if peek() != "phrase":
            raise QueryError("a phrase is missing")
        text = normal_query(take())
        if not text:
            raise QueryError("a phrase holds nothing to search for")
        if peek() == "quorum":
            return Quorum(tuple(text.split()) if " " in text else tuple(text), float(take()))
        terms, gaps = [text], []
        while peek() == "near":
            gaps.append(int(take()))
            if peek() != "phrase":
                raise QueryError("NEAR needs a second term")
            terms.append(normal_query(take()))
        return Near(tuple(terms), tuple(gaps)) if gaps else Phrase(text)

    tree = either()
    if at < len(tokens):
        raise QueryError(f"unexpected {tokens[at][1]!r}")
    return tree


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


class OfText:
    """What a query asks of one searchable text: whether it holds a phrase, and how often."""

    def __init__(self, text: Column):
        self.text = text

    def holds(self, q: str) -> Column:
        return F.contains(self.text, F.lit(q))

    def hits(self, q: str) -> Column:
        return hits(self.text, q)


def predicate(tree, text: Column | OfText) -> Column:
    """Whether a searchable text matches; NEAR is only narrowed down, search.match() decides by kwic.near()."""
    of = OfText(text) if isinstance(text, Column) else text
    match tree:
        case Phrase(q):
            return of.holds(q)
        case And(parts):
            return _all([predicate(p, of) for p in parts])
        case Or(parts):
            return reduce(lambda a, b: a | b, [predicate(p, of) for p in parts])
        case Not(part):
            return ~predicate(part, of)
        case Near(terms, _):
            return _all([of.holds(t) for t in terms])
        case Exclude(q, longer):
            return of.holds(q) & (of.hits(q) > of.hits(longer))
        case Quorum(parts, least):
            distinct = list(dict.fromkeys(parts))
            need = least * len(distinct) if least < 1 else min(least, len(distinct))
            return reduce(lambda a, b: a + b, [of.holds(p).cast("int") for p in distinct]) >= need
    raise TypeError(tree)


def hit_count(tree, text: Column | OfText) -> Column:
    """Occurrences of all phrases that count for a match."""
    of = OfText(text) if isinstance(text, Column) else text
    match tree:
        case Phrase(q):
            return of.hits(q)
        case And(parts) | Or(parts):
            counted = [hit_count(p, of) for p in parts if not isinstance(p, Not)]
            return reduce(lambda a, b: a + b, counted) if counted else F.lit(0).cast("long")
        case Not(_):
            return F.lit(0).cast("long")
        case Near():
            return F.lit(0).cast("long")  # its tuples are counted where they are found
        case Exclude(q, longer):
            return of.hits(q) - of.hits(longer)
        case Quorum(parts, _):
            return reduce(lambda a, b: a + b, [of.hits(p) for p in dict.fromkeys(parts)])
    raise TypeError(tree)


def mentioned(tree) -> list[str]:
    """Every phrase that decides a match, negated and excluded ones too."""
    match tree:
        case Not(part):
            return mentioned(part)
        case And(parts) | Or(parts):
            return list(dict.fromkeys(q for p in parts for q in mentioned(p)))
        case Exclude(q, longer):
            return [q, longer]
    return phrases(tree)


def matches_nothing_held(tree) -> bool:
    """Whether a text that holds none of the phrases matches."""
    match tree:
        case Not(part):
            return not matches_nothing_held(part)
        case And(parts):
            return all(map(matches_nothing_held, parts))
        case Or(parts):
            return any(map(matches_nothing_held, parts))
        case Quorum(_, least):
            return least <= 0
    return False


def near_parts(tree) -> list[Near]:
    """The NEAR chains that a text must have; elsewhere than in an AND they can't be verified."""

    def inside(t) -> bool:
        return isinstance(t, Near) or any(inside(p) for p in (t.parts if isinstance(t, (And, Or)) else [t.part] if isinstance(t, Not) else []))

    if isinstance(tree, Near):
        return [tree]
    if isinstance(tree, And):
        return [n for p in tree.parts for n in near_parts(p)]
    if inside(tree):
        raise QueryError("NEAR stands alone or in an AND")
    return []


def phrases(tree) -> list[str]:
    """The phrases that are searched for, without negated ones."""
    match tree:
        case Phrase(q):
            return [q]
        case And(parts) | Or(parts):
            return [q for p in parts for q in phrases(p)]
        case Near(terms, _):
            return list(terms)
        case Exclude(q, _):
            return [q]
        case Quorum(parts, _):
            return list(dict.fromkeys(parts))
    return []
