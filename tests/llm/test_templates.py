"""Decontamination by templates and slots against brute force on generated questions."""

import collections
import random

import pytest
import regex

from stemma.llm import decontaminate as D

NAMES = regex.compile(D._NAMES)
PARTS = regex.compile(D._PARTS)
rng = random.Random(8)
PEOPLE = ["Anna", "Bert", "Clara", "Dora"]
UNIT = ["km", "hours", "dollars", "kg"]
COMMON = ["the", "old", "miller", "walks", "to", "market", "and", "buys", "sells", "each", "with", "many", "apples", "before", "noon", "then", "how", "much", "is", "left"]


def tokens(text):
    return [w for w in PARTS.split(NAMES.sub(D.NAME, text or "")) if w]


def template(words):
    number = lambda w: "0" <= w[0] <= "9"
    out = []
    for i, w in enumerate(words):
        unit = i and number(words[i - 1]) and w.lower() in D.UNITS
        out.append("#" if number(w) else "@" if w.startswith(D.NAME) else "%" if unit else w.lower())
    return out


def item_windows(words):
    """(width or None, {place: (what must be equal, without placeholders)})."""
    t, low = template(words), [w.replace(D.NAME, "").lower() for w in words]
    told = {i: (tuple(t[i : i + D.WINDOW]), not set("#@%") & set(t[i : i + D.WINDOW])) for i in range(len(t) - D.WINDOW + 1) if sum(x in ("#", "@", "%") for x in t[i : i + D.WINDOW]) <= D.WINDOW // 2}
    if len(t) < D.WINDOW:
        enough = sum(regex.match(r"[\p{L}\p{N}]", c) is not None for c in "".join(words)) >= D.LEAST_CHARS
        return (len(t), {0: (tuple(low), True)}) if enough and t else (None, {})
    if len(told) < min(D.MIN_MATCHES, len(t) - D.WINDOW + 1):
        return D.WINDOW, {i: (tuple(low[i : i + D.WINDOW]), True) for i in range(len(t) - D.WINDOW + 1)}
    return None, told


def leak(text, item):
    """(windows, share, slots, kind) of a text and an item, or None."""
    words, asked = tokens(text), tokens(item)
    width, windows = item_windows(asked)
    t, it = template(words), template(asked)
    mine = [w.replace(D.NAME, "").lower() for w in words] if width else t
    by_place = collections.defaultdict(list)
    size = width or D.WINDOW
    for p in range(len(mine) - size + 1):
        by_place[tuple(mine[p : p + size])].append(p)
    diagonals = collections.defaultdict(list)
    for i, (w, plain) in windows.items():
        for p in by_place.get(w, ()):
            diagonals[p - i].append((i, plain))
    need, found = min(D.MIN_MATCHES, len(windows)), []
    for diagonal, at in diagonals.items():
        if len(at) < need:
            continue
        first, last = min(at)[0], max(at)[0]
        pairs = collections.defaultdict(list)
        n = 0
        for i in range(first, min(len(it), last + D.WINDOW)):
            if it[i] in ("#", "@", "%"):
                p, n = i + diagonal, n + 1
                given = (t[p], words[p].lower()) if 0 <= p < len(t) and t[p] in ("#", "@", "%") else None
                pairs[it[i], asked[i].lower()].append(given)
        steady = all(None not in v and len(set(v)) == 1 and v[0][0] == kind for (kind, _), v in pairs.items())
        same = all(all(g is not None and g[1] == value for g in v) for (_, value), v in pairs.items())
        if steady or sum(plain for _, plain in at) >= need:
            found.append((len(at), n, same))
    if not found:
        return None
    most = max(f[0] for f in found)
    return most, most / len(windows), max(f[1] for f in found if f[0] == most), "literal" if any(f[2] for f in found) else "reparameterised"


def question():
    out = []
    for _ in range(rng.randrange(3, 34)):
        kind = rng.random()
        out += [str(rng.randrange(2, 60)), *([rng.choice(UNIT)] if rng.random() < 0.5 else [])] if kind < 0.15 else [rng.choice(PEOPLE)] if kind < 0.25 else [rng.choice(COMMON)]
    return " ".join(out)


def changed(item):
    """Other numbers, names and units, mostly the same one for the same one; sometimes an edited word."""
    steady, out, other = rng.random() < 0.7, [], {}
    for w in item.split():
        pool = PEOPLE if w in PEOPLE else UNIT if w in UNIT else [str(n) for n in range(2, 60)] if w.isdigit() else None
        if pool and rng.random() < 0.9:
            w = other.setdefault(w, rng.choice(pool)) if steady else rng.choice(pool)
        elif not pool and rng.random() < 0.03:
            w = "edited"
        out.append(w)
    return " ".join(out)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_templates_and_slots(spark, broadcast, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    items = [question() for _ in range(40)]
    texts = []
    for _ in range(160):
        parts = [question(), rng.choice([changed, str])(rng.choice(items)), question()]
        texts.append(rng.choice(["", "So: "]) + (". " if rng.random() < 0.5 else " ").join(parts))
    texts += [None, "", items[0] + " " + changed(items[0]) + " " + items[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, round(r.coverage, 9), r.n_slots, r.kind) for r in D.find_leaks(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    want = {(d, i): leak(t, x) for d, t in enumerate(texts) if t for i, x in enumerate(items)}
    want = {k: (v[0], round(v[1], 9), *v[2:]) for k, v in want.items() if v}
    assert len(want) > 90 and {v[3] for v in want.values()} == {"literal", "reparameterised"}
    assert got == want
