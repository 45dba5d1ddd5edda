"""Folds of forests by contraction, against walks from node to node."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborframe.operators import contraction
from arborframe.operators.morphometrics import strahler_orders

from forests import grown


def plain(parent, value):
    up, top, depth = {}, {}, {}
    for v in parent:
        way = [v]
        while parent[way[-1]] is not None and parent[way[-1]] in parent:
            way.append(parent[way[-1]])
        up[v], top[v], depth[v] = sum(value[w] for w in way), way[-1], len(way)
    total, high, reach = dict(value), dict(value), {v: up[v] for v in parent}
    order, kids = {}, {v: [] for v in parent}
    for v in sorted(parent, key=lambda v: -depth[v]):
        held = sorted((order[c] for c in kids[v]), reverse=True) + [0, 0]
        order[v] = 1 if not kids[v] else held[0] + (held[0] == held[1])
        p = parent[v]
        if p in parent:
            kids[p].append(v)
            total[p] += total[v]
            high[p] = max(high[p], high[v])
            reach[p] = max(reach[p], reach[v])
    return {v: (top[v], up[v], total[v], high[v], reach[v] - up[v], order[v]) for v in parent}


def climbed(spark, forests, width, **more):
    rows = [(k, v, p, i % 7 - 2) for k, f in forests.items() for i, (v, p) in enumerate(f.items())]
    nodes = spark.createDataFrame(rows, "tree string, id long, up long, w long")
    found = contraction.climb(
        nodes, ["tree"], node="id", parent=F.col("up"), up={"sum_up": F.col("w") + 2},
        below={"total": ("sum", F.col("w")), "high": ("max", F.col("w"))}, reach={"far": "sum_up"},
        orders="strahler", width=width, **more,
    )
    return {(r["tree"], r["id"]): r for r in found.collect()}


@pytest.mark.parametrize("width", [3, 40, 1 << 16])
def test_climb(spark, width):
    draw = random.Random(width)
    forests = {f"t{k}": grown(draw, n, s) for k, (n, s) in enumerate([(1, 1), (60, 60), (200, 5), (90, 90)])}
    forests["orphans"] = {5: 99, 6: 5, 7: 99}
    got = climbed(spark, forests, width)
    assert len(got) == sum(map(len, forests.values()))
    for tree, parent in forests.items():
        value = {v: i % 7 - 2 for i, v in enumerate(parent)}
        ups = plain(parent, {v: w + 2 for v, w in value.items()})
        for v, (top, _, total, high, _, order) in plain(parent, value).items():
            r = got[tree, v]
            assert (r["_summit"], r["sum_up"], r["total"], r["high"]) == (top, ups[v][1], total, high)
            assert r["far"] == ups[v][4]
            assert r["strahler"] in ((order,) if width > 1000 else (order, None))


def test_climb_without_keys_or_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (9, 2)], "id long, up long")
    for width in (1, 1 << 16):
        got = contraction.climb(
            rows, [], node="id", parent=F.col("up"), up={"n": F.lit(1)}, below={"m": ("sum", F.lit(1))},
            orders="o", width=width,
        )
        assert sorted((r["id"], r["n"], r["m"]) for r in got.collect()) == [(1, 1, 3), (2, 2, 2), (9, 3, 1)]
    none = contraction.climb(rows.limit(0), [], node="id", parent=F.col("up"), up={"n": F.lit(1)})
    assert none.collect() == []


def test_nodes_without_numbers(spark):
    """Nodes that cannot be cut into slices are followed by doubling alone."""
    rows = [("a", None)] + [(f"n{i}", f"n{i - 1}" if i else "a") for i in range(20)]
    nodes = spark.createDataFrame(rows, "id string, up string")
    got = contraction.climb(
        nodes, [], node="id", parent=F.col("up"), up={"n": F.lit(1.0)}, below={"m": ("sum", F.lit(1))},
        reach={"r": "n"},
    )
    assert {r["id"]: (r["n"], r["m"], r["r"]) for r in got.collect()} == {
        "a": (1.0, 21, 20.0), **{f"n{i}": (i + 2.0, 20 - i, 19.0 - i) for i in range(20)}
    }


def test_strahler_orders_of_cut_trees(spark, monkeypatch):
    draw = random.Random(8)
    forest = grown(draw, 150, 4)
    rows = [("t", v, -1 if p is None else p) for v, p in forest.items()]
    table = spark.createDataFrame(rows, "tree string, section_id long, parent_section_id long")
    want = {v: r[5] for v, r in plain(forest, dict.fromkeys(forest, 1)).items()}
    whole = strahler_orders(table, ["tree"])
    assert {r["section_id"]: r["strahler"] for r in whole.collect()} == want
    real = contraction.climb
    monkeypatch.setattr(
        "arborframe.operators.morphometrics.climb", lambda *a, **k: real(*a, **{**k, "width": 7})
    )
    cut = strahler_orders(table, ["tree"])
    assert {r["section_id"]: r["strahler"] for r in cut.collect()} == want


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_large_trees(spark, shape):
    """A chain and a star of 200,000 nodes lie in several pieces."""
    n = 200_000
    up = F.col("id") - 1 if shape == "chain" else F.lit(0)
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, up).alias("up"))
    began = time.perf_counter()
    got = contraction.climb(
        nodes, [], node="id", parent=F.col("up"), up={"depth": F.lit(1)}, below={"size": ("sum", F.lit(1))},
        reach={"far": "depth"},
    )
    sums = got.agg(F.sum("depth"), F.sum("size"), F.sum("far"), F.max("_summit"), F.max("size")).first()
    if shape == "chain":
        assert tuple(sums) == (n * (n + 1) // 2, n * (n + 1) // 2, n * (n - 1) // 2, 0, n)
    else:
        assert tuple(sums) == (2 * n - 1, 2 * n - 1, 1, 0, n)
    assert time.perf_counter() - began < 120


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=1, max_size=31))
def test_piece(parents):
    """Folds inside a piece; a node's parent is an older one or none."""
    parent = {i: (p if 0 <= p < i else None) for i, p in enumerate(parents)}
    n = len(parent)
    hop = np.array([0 if p is None else p for p in parent.values()])
    linked = np.array([p is not None for p in parent.values()])
    piece = contraction.Piece(np.zeros(n, np.int64), np.arange(n), hop, linked)
    value = {i: i % 5 for i in parent}
    held = np.array(list(value.values()))
    rows = zip(piece.tops(), piece.up(held), piece.below(held, "sum"), piece.below(held, "max"), piece.orders())
    for (v, want), got in zip(plain(parent, value).items(), rows):
        assert tuple(int(x) for x in got) == (*want[:4], want[5])


@pytest.mark.parametrize("width", [3, 50, 1 << 16])
def test_ways_up(spark, width):
    draw = random.Random(width)
    forests = {f"t{k}": grown(draw, n, s) for k, (n, s) in enumerate([(1, 1), (60, 60), (120, 4)])}
    rows = [(k, v, p) for k, f in forests.items() for v, p in f.items()]
    nodes = spark.createDataFrame(rows, "tree string, id long, up long")
    want = set()
    for tree, parent in forests.items():
        for v in parent:
            at, steps = v, 0
            while at is not None:
                want.add((tree, v, at, steps))
                at, steps = parent[at], steps + 1
    got = contraction.ways_up(nodes, ["tree"], node="id", parent=F.col("up"), width=width).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    asked = [(t, v, (v % 4) + (0 if v % 3 else 2)) for t, v, _ in rows if v % 2] * 2 + [("t1", 10_000, 3), ("none", 1, 3)]
    of = spark.createDataFrame(asked, "tree string, id long, far int")
    got = contraction.ways_up(nodes, ["tree"], node="id", parent=F.col("up"), of=of, most="far", width=width)
    far = {(t, v): n for t, v, n in asked}
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[3] < far.get(w[:2], 0))
