import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.functions.draws import uniform
from arborframe.operators import clustering as C
from arborframe.operators import spatial as S


def cloud(seed, n, spread=10.0, blob=0):
    rng = random.Random(seed)
    pts = [(i, "g" if i % 3 else "h", *(round(rng.uniform(0, spread), 4) for _ in range(3))) for i in range(n)]
    pts += [(n + i, "g", *(5 + rng.uniform(0, 0.3) for _ in range(3))) for i in range(blob)]
    return pts


def frame(spark, pts):
    return spark.createDataFrame(pts, "id long, grp string, x double, y double, z double")


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))


def union_find(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def close_pairs(pts, r):
    return {(p[0], q[0]) for n, p in enumerate(pts) for q in pts[n + 1:] if p[1] == q[1] and d2(p, q) <= r * r}


def test_pairs_with_crowded_cells(spark):
    pts = cloud(1, 120, blob=40)
    got = S.pairs_within(frame(spark, pts), ["grp"], 2.0, crowd=5).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == close_pairs(pts, 2.0)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.id: r.component for r in S.components(edges, []).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_close_components_by_descent(spark):
    pts = cloud(2, 150, blob=60)
    for radius, crowd in ((1.2, 4), (0.9, 100_000)):
        got = {r.id: r.component for r in S.close_components(frame(spark, pts), ["grp"], radius, crowd=crowd).collect()}
        assert got == union_find([p[0] for p in pts], close_pairs(pts, radius))


def test_nearest_in_and_without_groups(spark):
    pts = cloud(3, 160, blob=40)
    df = frame(spark, pts)
    got = S.nearest(df, S.Octree(df, ["grp"], leaf=4, most=4), k=3, skip_self=True).collect()
    for p in pts:
        near = sorted((d2(p, q) ** 0.5, q[0]) for q in pts if q[1] == p[1] and q[0] != p[0])[:3]
        mine = sorted((r["rank"], r.near_id) for r in got if r.id == p[0])
        assert [i for _, i in mine] == [i for _, i in near]
    asks = frame(spark, cloud(4, 30, spread=30.0))
    far = {r.id: r.distance for r in S.nearest_distance(asks, df).collect()}
    for p in cloud(4, 30, spread=30.0):
        assert abs(far[p[0]] - min(d2(p, q) for q in pts) ** 0.5) < 1e-9


def nearest_by_hand(pts, k):
    out = {}
    for p in pts:
        near = sorted((d2(p, q) ** 0.5, q[0]) for q in pts if q[1] == p[1] and q[0] != p[0])
        out[p[0]] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_nearest_with_coincident_points_and_small_groups(spark, k):
    pts = [(i, "one place", 1.0, 2.0, 3.0) for i in range(40)]
    pts += [(50, "pair", 0.0, 0.0, 0.0), (51, "pair", 1.0, 0.0, 0.0), (52, "alone", 0.0, 0.0, 0.0)]
    pts += [(60 + i, "three", 1.0 if i < 3 else 49.0, 0.0, 0.0) for i in range(4)]
    pts += [(70, "three", 0.0, 0.0, 0.0)]
    for n in range(1, k + 3):
        pts += [(100 * n + i, f"of {n}", float(i * i), 0.0, 0.0) for i in range(n)]
    df = frame(spark, pts)
    got = {}
    for r in S.nearest(df, S.Octree(df, ["grp"], leaf=2, most=k + 1), k=k, skip_self=True).collect():
        got.setdefault(r.id, []).append((r["rank"], r.near_id))
    want = nearest_by_hand(pts, k)
    assert {i: [n for _, n in sorted(found)] for i, found in got.items()} == {
        i: near for i, near in want.items() if near
    }


def test_nearest_with_far_outliers(spark):
    """Two blobs, each far smaller than the last level of a tree over all of them, and an outlier."""
    draw = random.Random(6)
    pts = [(i, "g", *[draw.random() for _ in "xyz"]) for i in range(120)]
    pts += [(200 + i, "g", 3e7 + draw.random(), draw.random(), 0.5) for i in range(60)]
    pts += [(900, "g", 1e9, 1e9, -1e9)]
    df = frame(spark, pts)
    tree = S.Octree(df, ["grp"], leaf=4, most=3)
    assert tree.depth > S.Octree.PASS[0]
    assert tree.pyramid.filter("is_leaf").selectExpr("max(n)").first()[0] <= 4
    assert tree.pyramid.filter("is_leaf").selectExpr("sum(n)").first()[0] == len(pts)
    got = {}
    for r in S.nearest(df, tree, k=2, skip_self=True).collect():
        got.setdefault(r.id, []).append((r["rank"], r.near_id))
    assert {i: [n for _, n in sorted(found)] for i, found in got.items()} == nearest_by_hand(pts, 2)
    asks = frame(spark, [(i, "g", draw.random() * 4e7, 0.0, 0.0) for i in range(20)])
    far = {r.id: r.distance for r in S.nearest_distance(asks, df).collect()}
    for p in asks.collect():
        assert abs(far[p[0]] - min(d2(p, q) for q in pts) ** 0.5) < 1e-6


def test_thinning_equals_the_greedy_walk(spark):
    pts = cloud(5, 150, blob=30)
    df = frame(spark, pts)
    order = {r.id: r.u for r in df.select("id", uniform("id").alias("u")).collect()}
    got = {r.id for r in S.thin(df, ["grp"], 1.5, priority=[uniform("id")]).collect()}
    kept = []
    for p in sorted(pts, key=lambda p: (order[p[0]], p[0])):
        if all(q[1] != p[1] or d2(p, q) > 2.25 for q in kept):
            kept.append(p)
    assert got == {p[0] for p in kept}


@pytest.mark.parametrize("small", [S.THIN_SMALL, 60, 0])  # all in tasks; the larger group in rounds; both
def test_thinning_of_small_and_large_groups(spark, small):
    pts = cloud(6, 150, blob=30)
    got = {r.id for r in S.thin(frame(spark, pts), ["grp"], 1.5, priority=[F.lit(0)], small=small).collect()}
    kept = []
    for p in pts:
        if all(q[1] != p[1] or d2(p, q) > 2.25 for q in kept):
            kept.append(p)
    assert got == {p[0] for p in kept}


def test_shifted_copies_are_not_broadcast(spark):
    """125 copies of a small table passed as one row each, and the driver had to hold them."""
    df = frame(spark, cloud(7, 40))
    cells = df.select("grp", "id", *S.geo.AXES, *S._cells(1.0))
    for joined in (
        S._shifted(cells, S._offsets(2, forward_only=False)).join(cells.select("grp", *S.CELL), ["grp", *S.CELL]),
        S.pairs_within(df, ["grp"], 1.0),
    ):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("_salt")[0]
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def release_by_hand(members):
    """The sequence of merges written out: smallest cluster first, farthest members released."""
    clusters = {}
    for i, label, dist, ok in members:
        if ok:
            clusters.setdefault(label, []).append((dist, i))
    outside = {i: True for i, *_ in members}
    released = set()
    done = set()
    for n, (label, rows) in enumerate(sorted(clusters.items(), key=lambda c: (len(c[1]), c[0]))):
        done |= {i for _, i in rows}
        free = len(members) - len(done) + len(released)
        if free + n + 1 <= 3:
            far = sorted(rows, reverse=True)[: max(0, 3 - free - n)]
            released |= {i for _, i in far}
    del outside
    return released


def test_release_keeps_four_points(spark):
    cases = {
        "all in one": [(i, 0, float(i), True) for i in range(6)],
        "one left": [(i, 0, float(i), True) for i in range(5)] + [(9, 1, 0.0, False)],
        "two clusters": [(i, i % 2, float(i), True) for i in range(8)],
        "two clusters, one left": [(i, i % 2, float(i), True) for i in range(8)] + [(9, 3, 0.0, False)],
        "three clusters": [(i, i % 3, float(i), True) for i in range(9)],
        "enough": [(i, 0, float(i), True) for i in range(5)] + [(10 + i, 5 + i, 0.0, False) for i in range(4)],
    }
    rows = [(name, *m) for name, ms in cases.items() for m in ms]
    df = spark.createDataFrame(rows, "grp string, id long, label long, distance double, is_cluster boolean")
    got = C.release_farthest(df, ["grp"]).collect()
    for name, ms in cases.items():
        assert {r.id for r in got if r.grp == name and r.released} == release_by_hand(ms), name


def test_poor_trees_are_split_at_the_common_ancestor(spark):
    # root 1 - 2 - {3 - {5, 6}, 4 - {7, 8 - {9, 10}}}
    parent = {1: -1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4, 9: 8, 10: 8}
    nodes = spark.createDataFrame([("t", i, p, float(i), 0.0, 0.0) for i, p in parent.items()], "m string, id long, parent_id long, x double, y double, z double")
    ends = nodes.filter("id in (1, 5, 6, 7, 9, 10)").select("m", "id", "x", "y", "z", (F.col("id") == 1).alias("is_root"))
    clusters, members = C.sphere_parent_clusters(nodes, ends, ["m"], C.ClusterConfig("sphere_parents", sphere_radius=100.0))
    parts = {}
    for r in members.collect():
        parts.setdefault(r.tuft_id, set()).add(r.id)
    assert parts[0] == {1} and len(parts) == 4
    assert sorted(map(sorted, (v for k, v in parts.items() if k))) in ([[5], [6], [7, 9, 10]], [[5, 6], [7], [9, 10]])
    assert sum(r["size"] for r in clusters.collect()) == 6


def test_config_checks():
    import pytest

    assert C.ClusterConfig("sphere").sphere_radius == 100.0
    assert C.ClusterConfig("sphere_parents", sphere_radius=7.0).path_limit == 7.0
    for bad in (dict(method="barcodes"), dict(method="sphere", sphere_radius=0), dict(method="sphere", min_size=0), dict(method="sphere_parents", max_path_distance=-1)):
        with pytest.raises(ValueError):
            C.ClusterConfig(**bad)
    with pytest.raises(ValueError):
        C.method_of(None, C.ClusterConfig("brain_regions"))


def test_close_components_alike_in_tasks_and_over_cells(spark, monkeypatch):
    pts = cloud(7, 200, blob=50)
    df = frame(spark, pts).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    want = union_find([p[0] for p in pts], close_pairs(pts, 1.1))
    for small in (8192, 70, 0):
        rows = S.close_components(df, ["grp"], 1.1, carry=["name"], small=small, crowd=4).collect()
        assert {r.id: r.component for r in rows} == want and len(rows) == len(pts)
        assert all(r.name == f"n{r.id}" for r in rows)
    monkeypatch.setattr(S, "CLOSE_PAIRS", 10)
    order = sorted(range(len(pts)), key=lambda i: (pts[i][1], pts[i][0]))
    group = np.array([hash(pts[i][1]) for i in order])
    first = S.linked(group, np.array([pts[i][2:5] for i in order], float), 1.1 * 1.1)
    assert {pts[i][0]: pts[order[f]][0] for i, f in zip(order, first)} == want


def test_small_groups_of_close_points_move_once(spark, monkeypatch):
    monkeypatch.setattr(S, "_close_over_cells", None)
    df = frame(spark, cloud(2, 150, blob=60))
    plan = S.close_components(df, ["grp"], 1.2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_targets_without_a_place_or_an_axon_keep_their_id(spark):
    from arborframe.operators import sampling as P

    rows = [("m", 0, 1, 0.0, "a"), ("m", 0, 2, 1.0, "b"), ("m", 0, 3, None, "c"), ("m", 1, 4, 1.0, "d"), (None, 0, 5, 0.0, "e"), (None, 0, 6, 0.0, "f")]
    df = spark.createDataFrame(rows, "morphology string, axon_id long, terminal_id long, target_x double, name string")
    df = df.withColumns({"target_y": F.lit(0.0), "target_z": F.lit(0.0)})
    got = {r.name: r.terminal_id for r in P.merge_close_targets(df, 2.0).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 4, "e": 5, "f": 6}
