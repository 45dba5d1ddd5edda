import random

import pytest

from arborframe.operators import graph as G

EDGE = "m string, `from` long, `to` long, weight double, tag long"
NODE = "m string, id long, is_terminal boolean, terminal_id long, provider string"


def graphs():
    """Random graphs with equal costs, parallel edges, parts out of reach and nodes that are not listed."""
    rng = random.Random(11)
    edges, nodes = [], []
    for m, size, count in (("a", 30, 70), ("b", 12, 40), ("c", 50, 60), ("d", 5, 6)):
        for n in range(count):
            a, b = rng.randrange(size), rng.randrange(size)
            if a != b:
                edges.append((m, a, b, float(rng.randrange(1, 4)), len(edges)))
        nodes += [(m, i, i == 0 or rng.random() < 0.3, i * 10, "source" if i == 0 else "target") for i in range(size) if i != 7]
    nodes += [("e", 0, True, 0, "source"), ("e", 1, True, 10, "target")]
    # of two parallel edges of one weight and direction any may carry the way
    once = {(m, a, b, w): (m, a, b, w, t) for m, a, b, w, t in edges}
    return list(once.values()), nodes


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_graphs_in_tasks_and_in_rounds_give_the_same_ways_and_trees(spark):
    edges, nodes = graphs()
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)
    start = n.filter("provider = 'source'").select("m", "id")
    want = rows(G._paths_in_rounds(e, start, ["m"]))
    met, solution = G._tree_in_rounds(n, e, ["m"])
    met, solution = rows(met), rows(solution)
    assert len(want) > 60 and len(solution) > 20
    for most in (1000, 50, 0):
        assert rows(G.shortest_paths(e, start, ["m"], most=most)) == want
        got, tree = G.connecting_tree(n, e, ["m"], most=most)
        assert rows(got) == met
        assert rows(tree) == solution


def test_small_graphs_move_once_and_take_no_rounds(spark, monkeypatch):
    edges, nodes = graphs()
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)
    for name in ("Rounds", "run_heads", "fold"):
        monkeypatch.setattr(G, name, None)
    solution = G.connecting_tree(n, e, ["m"])[1]
    plan = solution._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert G.orient_tree(solution.filter("m = 'd'"), ["m"]).count() == solution.filter("m = 'd'").count()


def test_trees_are_toured_alike_in_tasks_and_in_rounds(spark):
    rng = random.Random(2)
    edges = []
    for m, size in (("a", 40), ("b", 3), ("c", 90), ("d", 2)):
        for child in range(1, size):
            top = child - 1 if m == "c" and child < 60 else rng.randrange(child)
            edges.append((m, child, top) if rng.random() < 0.5 else (m, top, child))
    df = spark.createDataFrame(edges, "m string, `from` long, `to` long")
    from pyspark.sql import functions as F

    for root in (0, F.when(F.col("m") == "c", F.lit(5)).otherwise(F.lit(1)).cast("bigint")):
        start = F.lit(root).cast("bigint") if isinstance(root, int) else root
        want = rows(G._tour_in_rounds(df, ["m"], start))
        assert len(want) == len(edges)
        for most in (1000, 50, 0):
            assert rows(G.orient_tree(df, ["m"], root=root, most=most)) == want


def test_edges_that_are_no_tree_are_refused(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 2, 3)], "m string, `from` long, `to` long")
    with pytest.raises(Exception, match="not one tree"):
        G.orient_tree(df, ["m"]).collect()
