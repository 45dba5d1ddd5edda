import heapq
import random

from arborframe.operators import graph as G

EDGE = "m string, `from` long, `to` long, weight double"


def test_costs_equal_dijkstra(spark):
    rng = random.Random(7)
    edges = {(min(a, b), max(a, b)): round(rng.uniform(1, 9), 3) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(110)) if a != b}
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    cost, heap = {}, [(0.0, 0)]
    while heap:
        c, n = heapq.heappop(heap)
        if n in cost:
            continue
        cost[n] = c
        for k, w in near.get(n, []):
            heapq.heappush(heap, (c + w, k))
    df = spark.createDataFrame([("m", a, b, w) for (a, b), w in edges.items()], EDGE)
    got = {r.id: r.cost for r in G.shortest_paths(df, spark.createDataFrame([("m", 0)], "m string, id long"), ["m"]).collect()}
    assert got.keys() == cost.keys() and all(abs(got[n] - cost[n]) < 1e-9 for n in cost)


def test_orientation_walks_the_tree_from_its_root(spark):
    rng = random.Random(5)
    parent = {i: rng.randrange(i) for i in range(1, 60)}
    parent.update({i: i - 1 for i in range(60, 200)})
    rows, want = [], {}
    for child, top in parent.items():
        flip = rng.random() < 0.5
        rows.append(("m", child, top) if flip else ("m", top, child))
        want[(top, child)] = flip
    df = spark.createDataFrame(rows, "m string, `from` long, `to` long")
    got = G.orient_tree(df, ["m"], root=0).collect()
    assert {(r.parent, r.child): r.reversed_edge for r in got} == want
    place = {r.child: r.position for r in got}
    assert sorted(place.values()) == list(range(1, 200))
    assert all(top == 0 or place[top] < place[child] for child, top in parent.items())


def walk(spark, rows):
    cols = "m string, `from` long, `to` long, x_from double, y_from double, z_from double, x_to double, y_to double, z_to double"
    return spark.createDataFrame([("m", a, b, *map(float, p), *map(float, q)) for a, b, p, q in rows], cols)


def test_trunk_with_one_and_two_edges_at_the_root(spark):
    p = {0: (0, 0, 0), 1: (10, 0, 0), 2: (20, 10, 0), 3: (20, -10, 0)}
    one = walk(spark, [(0, 1, p[0], p[1]), (2, 1, p[2], p[1]), (1, 3, p[1], p[3])])
    sections, tagged = G.grow_trunk(one, ["m"])
    rows = {r.section_id: r for r in sections.collect()}
    assert len(rows) == 3 and rows[0].parent_section_id == -1 and rows[0].x_to == 10.0
    assert {(r.parent_section_id, r.x_from, r.y_to) for i, r in rows.items() if i} == {(0, 10.0, 10.0), (0, 10.0, -10.0)}
    assert {(r["from"], r["to"]): r.reversed_edge for r in tagged.collect()} == {(0, 1): False, (2, 1): True, (1, 3): False}
    two = walk(spark, [(0, 1, p[0], p[1]), (0, 2, p[0], p[2])])
    rows = {r.section_id: r for r in G.grow_trunk(two, ["m"])[0].collect()}
    assert len(rows) == 3 and (rows[0].x_to, round(rows[0].y_to, 6)) == (10.0, round(10 / 3, 6))
    assert all(r.x_from == 10.0 for r in rows.values() if r.section_id)
    graft = spark.createDataFrame([("m", 1.0, 2.0, 3.0)], "m string, x double, y double, z double")
    rows = {r.section_id: r for r in G.grow_trunk(one, ["m"], grafting=graft)[0].collect()}
    assert len(rows) == 4 and min(r.x_from for i, r in rows.items() if i) == 1.0


def test_terminal_penalty_spares_edges_that_only_touch_terminals(spark):
    edges = spark.createDataFrame([("m", 0, 1, 1.0), ("m", 0, 2, 3.0), ("m", 1, 2, 2.0)], EDGE)
    nodes = spark.createDataFrame([("m", 0, True), ("m", 1, True), ("m", 2, False)], "m string, id long, is_terminal boolean")
    got = {(r["from"], r["to"]): r.weight for r in G.terminal_penalty(edges, nodes, ["m"]).collect()}
    assert got == {(0, 1): 1.0 + 3.0 + 2.0, (0, 2): 3.0, (1, 2): 2.0}


def nearest_pairs(spots, k):
    out = set()
    for m, a, p in spots:
        near = sorted((sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5, b) for n, b, q in spots if n == m and b != a)
        out |= {(m, min(a, b), max(a, b)) for _, b in near[:k]}
    return out


def test_nearest_edges_carry_their_ends_in_small_and_large_groups(spark):
    rng = random.Random(3)
    spots = [(m, n * 3 - 4, tuple(float(rng.randrange(6)) for _ in range(3))) for m, count in (("a", 40), ("b", 9), ("c", 1), ("d", 2)) for n in range(count)]
    place = {(m, n): p for m, n, p in spots}
    nodes = spark.createDataFrame([(m, n, *p) for m, n, p in spots], "m string, id long, x double, y double, z double")
    want = nearest_pairs(spots, 3)
    for small in (8192, 10, 0):
        rows = G.nearest_edges(nodes, ["m"], k=3, small=small).collect()
        assert len(rows) == len(want) and {(r.m, r["from"], r.to) for r in rows} == want
        for r in rows:
            assert (r.x_from, r.y_from, r.z_from) == place[r.m, r["from"]] and (r.x_to, r.y_to, r.z_to) == place[r.m, r.to]
            assert abs(r.length - sum((u - v) ** 2 for u, v in zip(place[r.m, r["from"]], place[r.m, r.to])) ** 0.5) < 1e-12


def test_edges_meet_their_nodes_in_one_exchange_unless_a_graph_is_hot(spark):
    edges = spark.createDataFrame([("m", 0, 1, 1.0), ("m", 0, 2, 3.0), ("n", 1, 2, 2.0)], EDGE)
    nodes = spark.createDataFrame([("m", 0, 5), ("m", 1, 6), ("m", 2, 7), ("n", 1, 8), ("n", 2, 9)], "m string, id long, v long")

    def joined(e, n):
        e = e.join(n.withColumnsRenamed({"id": "from", "v": "a"}), ["m", "from"])
        return e.join(n.withColumnsRenamed({"id": "to", "v": "b"}), ["m", "to"])

    for most in (10, 2, 0):
        got = {(r.m, r["from"], r.to, r.a, r.b) for r in G.whole_graphs(edges, nodes, ["m"], joined, most=most).collect()}
        assert got == {("m", 0, 1, 5, 6), ("m", 0, 2, 5, 7), ("n", 1, 2, 8, 9)}
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        terminals = nodes.select("m", "id", (nodes.v > 6).alias("is_terminal"))
        plan = G.terminal_penalty(edges, terminals, ["m"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)
