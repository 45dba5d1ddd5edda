import random

from arborframe.operators import clustering as C


def test_close_paths_of_usual_and_of_hot_trees(spark, monkeypatch):
    rng = random.Random(11)
    rows, want = [], set()
    for m, count in (("a", 40), ("b", 14), ("c", 3)):
        up = {n: (-1 if n == 1 else n // 2) for n in range(1, count + 1)}
        at = {n: tuple(rng.uniform(0, 30) for _ in range(3)) for n in up}
        rows += [(m, n, up[n], *at[n]) for n in up]
        far = lambda p, q: sum((u - v) ** 2 for u, v in zip(at[p], at[q])) ** 0.5

        def way(n):
            return [n] + (way(up[n]) if up[n] > 0 else [])

        leaves = [n for n in up if 2 * n > count]
        for a in leaves:
            for b in leaves:
                if a < b and far(a, b) <= 20:
                    both = set(way(a)) & set(way(b))
                    path = (set(way(a)) ^ set(way(b))) | {max(both)}
                    if all(far(p, q) <= 28 for p in path for q in path):
                        want.add((m, a, b))
    nodes = spark.createDataFrame(rows, "m string, id long, parent_id long, x double, y double, z double")
    ends = nodes.join(nodes.selectExpr("m", "parent_id as id"), ["m", "id"], "left_anti").select("m", "id", "x", "y", "z")
    cfg = C.ClusterConfig("sphere_parents", sphere_radius=20.0, max_path_distance=28.0)
    assert want
    for most in (1 << 17, 3):
        monkeypatch.setattr(C, "MOST_PAIRS", most)
        got = [(r.m, r.a, r.b) for r in C.close_paths(nodes, ends, ["m"], cfg).collect()]
        assert len(got) == len(want) and set(got) == want
