"""Connected components, against union-find on the driver."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborframe.operators.components import Forest, components, spanning


def plain(edges):
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    return {v: forest.top(v) for v in forest.up}


def messy_graph(draw, n):
    """A hub with a high number, a chain, random edges, repeated ones, loops and missing ends."""
    edges = [(n + 7, draw.randrange(n)) for _ in range(n // 2)]
    edges += [(2 * n + i, 2 * n + i + 1) for i in range(40)]
    edges += [(draw.randrange(3 * n, 4 * n), draw.randrange(3 * n, 4 * n)) for _ in range(n // 3)]
    draw.shuffle(edges)
    return edges + edges[:5] + [(b, a) for a, b in edges[:5]]


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
@pytest.mark.parametrize("crowd", [3, 100_000])
def test_components(spark, kind, crowd):
    draw = random.Random(crowd)
    name = {"long": int, "string": lambda v: f"n{v:05}", "binary": lambda v: b"%05d" % v}[kind]
    rows, want = [], {}
    for g in ("x", "y"):
        edges = [(name(a), name(b)) for a, b in messy_graph(draw, 60)]
        rows += [(g, *e) for e in edges] + [(g, name(3), name(3)), (g, None, name(1)), (g, name(1), None)]
        want |= {(g, v): c for v, c in plain([e for e in edges if e[0] != e[1]]).items()}
    table = spark.createDataFrame(rows, f"grp string, a {kind}, b {kind}").repartition(7)
    got = components(table, ["grp"], crowd=crowd).collect()
    clean = lambda v: bytes(v) if kind == "binary" else v
    assert len(got) == len(want)
    assert {(r["grp"], clean(r["id"])): clean(r["component"]) for r in got} == want


@pytest.mark.parametrize("hub", [0, 300_000])
def test_star_and_chain(spark, hub):
    """A star around its smallest or its largest node, and a long chain, in few rounds."""
    star = spark.range(1, 200_000).select(F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(400_000, 430_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(star.unionByName(chain).repartition(8), [], crowd=10_000)
    sums = got.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in sums} == {(min(hub, 1), 200_000), (400_000, 30_001)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), []).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), []).collect() == []


def test_spanning_edges_join_the_same_nodes(spark):
    draw = random.Random(1)
    edges = [(max(e), min(e)) for e in messy_graph(draw, 80) if e[0] != e[1]]
    table = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for most in (10, 500_000):
        left = [tuple(r) for r in spanning(table, most=most).collect()]
        assert plain(left) == plain(edges) and all(u > v for u, v in left)
    assert len(left) < len(edges)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_forest(edges):
    label = plain(edges)
    assert all(label[a] == label[b] <= min(a, b) for a, b in edges)
    for v, c in label.items():
        assert label[c] == c


def test_groups_that_fit_into_a_task_take_no_rounds(spark, monkeypatch):
    from arborframe.operators import components as C

    draw = random.Random(4)
    rows, want = [], {}
    for g, n in (("x", 60), ("y", 20), ("z", 9)):
        edges = messy_graph(draw, n)
        rows += [(g, a, b) for a, b in edges] + [(g, 1, 1), (g, None, 1), (None, 1, 2)]
        want |= {(g, v): c for v, c in plain([e for e in edges if e[0] != e[1]]).items()}
    table = spark.createDataFrame(rows, "grp string, a long, b int")
    for most in (10_000, 100, 0):
        got = components(table.dropna(subset="grp"), ["grp"], most=most).collect()
        assert {(r.grp, r.id): r.component for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(C, "_in_rounds", None)
    found = components(table, ["grp"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(r.grp, r.id): r.component for r in found.collect()} == want
    assert plan.count("Exchange hashpartitioning") == 1
