"""Interval labels and common ancestors, against walks from node to node."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborframe.operators import intervals, trees

from forests import grown


def way(parent, v):
    out = []
    while v is not None:
        out.append(v)
        v = parent[v]
    return out


def common(parent, members):
    ways = [set(way(parent, v)) for v in members]
    shared = set.intersection(*ways)
    return max(shared, key=lambda v: len(way(parent, v)), default=None)


def forests(seed):
    draw = random.Random(seed)
    return {f"t{k}": grown(draw, n, s) for k, (n, s) in enumerate([(1, 1), (70, 70), (150, 5)])}


def table(spark, many):
    rows = [(k, v, p) for k, f in many.items() for v, p in f.items()]
    return spark.createDataFrame(rows, "tree string, id long, up long")


@pytest.mark.parametrize("width", [5, 1 << 16])
def test_labels(spark, width):
    many = forests(width)
    got = intervals.labels(table(spark, many), ["tree"], node="id", parent=F.col("up"), width=width).collect()
    assert len(got) == sum(map(len, many.values()))
    for tree, parent in many.items():
        at = {r["id"]: r for r in got if r["tree"] == tree}
        assert sorted(r["first"] for r in at.values()) == list(range(len(parent)))
        for v in parent:
            assert at[v]["depth"] == len(way(parent, v)) - 1
            below = {u for u in parent if v in way(parent, u)}
            assert {u for u in parent if at[v]["first"] <= at[u]["first"] <= at[v]["last"]} == below
        for v, p in parent.items():  # children by number
            beside = [u for u in parent if parent[u] == p]
            assert sorted(beside) == sorted(beside, key=lambda u: at[u]["first"])


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_lowest_common(spark, width):
    many = forests(3)
    labelled = intervals.labels(table(spark, many), ["tree"], node="id", parent=F.col("up"))
    draw = random.Random(width)
    pairs = [(t, draw.choice(list(f)), draw.choice(list(f))) for t, f in many.items() for _ in range(150)]
    asked = spark.createDataFrame([(*p, n) for n, p in enumerate(pairs)], "tree string, a long, b long, n int")
    got = {r["n"]: r["ancestor"] for r in intervals.lowest_common(labelled, asked, ["tree"], node="id", width=width).collect()}
    assert got == {n: common(many[t], [a, b]) for n, (t, a, b) in enumerate(pairs)}


def test_paths_of_sets(spark):
    many = forests(9)
    draw = random.Random(1)
    sets = {(t, f"s{k}"): draw.choices(list(f), k=draw.randint(1, 9)) for t, f in many.items() for k in range(6)}
    members = spark.createDataFrame([(*k, v) for k, own in sets.items() for v in own], "tree string, grp string, id long")
    nodes = table(spark, many)
    tufts, shared = {}, {}
    for (t, g), own in sets.items():
        top = common(many[t], own)
        if top is not None:
            on = {u for v in own for u in way(many[t], v)} - set(way(many[t], top)[1:])
            tufts |= {(t, g, u): u == top for u in on}
            line = way(many[t], top)
            shared |= {(t, g, u): (len(line) - 1 - k, k == 0) for k, u in enumerate(line)}
    got = trees.tuft_nodes(nodes, members, ["tree"], ["grp"], node="id", parent="up").collect()
    assert len(got) == len(tufts) and {tuple(r[:3]): r["is_common_ancestor"] for r in got} == tufts
    got = trees.common_path(nodes, members, ["tree"], ["grp"], node="id", parent="up").collect()
    assert len(got) == len(shared)
    assert {(r["tree"], r["grp"], r["ancestor"]): (r["depth"], r["is_lowest"]) for r in got} == shared


def test_no_nodes(spark):
    none = spark.createDataFrame([], "id long, up long")
    labelled = intervals.labels(none, [], node="id", parent=F.col("up"))
    assert labelled.collect() == []
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert intervals.lowest_common(labelled, pairs, [], node="id").collect() == []


def test_ancestor_test_joins_by_interval(spark):
    many = {"t": {1: None, 2: 1, 3: 1, 4: 2}}
    labelled = intervals.labels(table(spark, many), ["tree"], node="id", parent=F.col("up"))
    got = labelled.alias("a").join(labelled.alias("v"), intervals.is_above("a", "v")).select("a.id", "v.id").collect()
    assert {tuple(r) for r in got} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3), (4, 4)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_ranges(values):
    held = np.array(values)
    lo, hi = map(np.array, zip(*[(i, j) for i in range(len(values)) for j in range(i, len(values))]))
    got = held[intervals.Ranges(held).lowest(lo, hi)]
    assert got.tolist() == [min(values[i : j + 1]) for i, j in zip(lo, hi)]
