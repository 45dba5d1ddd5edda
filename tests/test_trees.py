import random

from pyspark.sql import functions as F

from arborframe.operators import morphometrics as S
from arborframe.operators import trees as T

SCHEMA = "morphology string, point_id long, type int, x double, y double, z double, radius double, parent_id long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_tree(n, seed):
    rng = random.Random(seed)
    parent = {1: -1}
    for i in range(2, n + 1):
        parent[i] = i - 1 if rng.random() < 0.5 else rng.randrange(max(1, i - 6), i)
    xyz = {i: tuple(round(rng.uniform(-50, 50), 3) for _ in range(3)) for i in parent}
    return parent, xyz


def rows_of(name, parent, xyz):
    return [(name, i, 2, *xyz[i], 1.0, p) for i, p in parent.items()]


def dist(a, b):
    return sum((u - v) ** 2 for u, v in zip(a, b)) ** 0.5


def test_a_long_chain_is_one_section(spark):
    n = 600
    pts = table(spark, [("c", i, 2, float(i), 0.0, 0.0, 1.0, i - 1 if i > 1 else -1) for i in range(1, n + 1)])
    secs = T.sections(T.assign_sections(pts)).collect()
    assert [(s.section_id, s.parent_section_id, s.first_point, s.last_point, s.n_points) for s in secs] == [(2, -1, 1, n, n)]
    assert secs[0].length == n - 1


def test_folds_match_a_recursive_walk(spark):
    parent, xyz = random_tree(120, 3)
    nodes = spark.createDataFrame([(i, p, float(i % 7)) for i, p in parent.items()], "id long, parent_id long, w double")
    got = T.fold(
        nodes, [], node="id", parent="parent_id", up={"depth": F.lit(1), "way": F.col("w")},
        below={"total": ("sum", F.col("w")), "least": ("min", F.col("id"))}, reach={"far": "way"},
    ).collect()
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)

    def below(i):
        return [i] + [d for k in kids.get(i, []) for d in below(k)]

    def far(i):
        return max([0.0] + [k % 7 + far(k) for k in kids.get(i, [])])

    for r in got:
        path, at = [], r.id
        while at != -1:
            path.append(at)
            at = parent[at]
        assert r.depth == len(path) and r.way == sum(i % 7 for i in path)
        assert r.total == sum(i % 7 for i in below(r.id)) and r.least == r.id and r.far == far(r.id)


def test_common_path_and_subset(spark):
    # 1 - 2 - 3 - {4 - {5, 6}, 7}
    parent = {1: -1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 3}
    nodes = spark.createDataFrame([("t", i, p) for i, p in parent.items()], "morphology string, id long, parent_id long")
    members = spark.createDataFrame([("t", "a", 5), ("t", "a", 6), ("t", "b", 5), ("t", "b", 7), ("t", "c", 7)], "morphology string, s string, id long")
    path = T.common_path(nodes, members, ["morphology"], ["s"], node="id", parent="parent_id").collect()
    low = {r.s: r.ancestor for r in path if r.is_lowest}
    assert low == {"a": 4, "b": 3, "c": 7}
    assert sorted(r.ancestor for r in path if r.s == "a") == [1, 2, 3, 4]
    sub = T.tuft_nodes(nodes, members, ["morphology"], ["s"], node="id", parent="parent_id").collect()
    assert sorted(r.id for r in sub if r.s == "b") == [3, 4, 5, 7]


def test_several_roots_are_reported(spark):
    nodes = spark.createDataFrame([("ok", 1, -1), ("ok", 2, 1), ("two", 1, -1), ("two", 2, -1)], "morphology string, id long, parent_id long")
    assert [(r.morphology, r.n_roots) for r in T.check_single_root(nodes, ["morphology"], node="id", parent="parent_id").collect()] == [("two", 2)]


def test_chains_break_at_branches_and_tufts(spark):
    rows = [("t", 1, -1, 1), ("t", 2, 1, 1), ("t", 3, 2, 1), ("t", 4, 3, 2), ("t", 5, 4, 0), ("t", 6, 4, 0)]
    secs = spark.createDataFrame(rows, "morphology string, section_id long, parent_section_id long, n_children long")
    whole = {r.section_id: (r.chain_id, r.chain_pos) for r in T.merge_chains(secs).collect()}
    assert whole == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (6, 0)}
    cut = spark.createDataFrame([("t", 1, False), ("t", 4, True)], "morphology string, section_id long, use_parent boolean")
    parts = {r.section_id: r.chain_id for r in T.merge_chains(secs, cut).collect()}
    assert parts == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_barcode_and_strahler_against_a_walk(spark):
    parent, xyz = random_tree(80, 11)
    pts = table(spark, rows_of("t", parent, xyz))
    secs = T.sections(T.assign_sections(pts))
    rows = {r.section_id: r for r in secs.collect()}
    kids = {}
    for s in rows.values():
        kids.setdefault(s.parent_section_id, []).append(s.section_id)

    def order(s):
        below = sorted((order(k) for k in kids.get(s, [])), reverse=True)
        return 1 if not below else below[0] + (len(below) > 1 and below[0] == below[1])

    got = {r.section_id: r.strahler for r in S.strahler_orders(secs, ["morphology"]).collect()}
    assert got == {s: order(s) for s in rows}

    def end(s):
        return 0.0 if s == -1 else rows[s].length + end(rows[s].parent_section_id)

    def far(s):
        return max([end(s)] + [far(k) for k in kids.get(s, [])])

    bars = S.barcodes(secs, ["morphology"]).collect()
    leaves = sum(1 for s in rows if s not in kids)
    heads = len(kids.get(-1, []))
    assert len(bars) == leaves and sum(b.death == 0 for b in bars) == heads
    for b in bars:
        assert abs(b.birth - far(b.section_id)) < 1e-9
        assert abs(b.death - end(rows[b.section_id].parent_section_id)) < 1e-9


def test_meander_angle_of_a_straight_line_is_pi(spark):
    pts = table(spark, [("s", i, 2, float(i), 0.0, 0.0, 1.0, i - 1 if i > 1 else -1) for i in range(1, 6)])
    row = S.trunk_properties(T.assign_sections(pts), ["morphology"]).first()
    assert (row.mean_segment_lengths, row.std_segment_lengths) == (1.0, 0.0)
    assert abs(row.mean_segment_meander_angles - 3.141592653589793) < 1e-12 and row.std_segment_meander_angles == 0


def test_resampling_a_line_onto_itself_and_its_middle(spark):
    a = spark.createDataFrame([("l", 1, 0.0, 0.0, 0.0, 1.0), ("l", 2, 4.0, 0.0, 0.0, 3.0), ("l", 3, 4.0, 4.0, 0.0, 9.0)], "morphology string, n long, x double, y double, z double, v double")
    b = spark.createDataFrame([("l", 1, 0.0, 0.0, 0.0), ("l", 2, 1.0, 0.0, 0.0), ("l", 3, 4.0, 0.0, 0.0)], "morphology string, n long, x double, y double, z double")
    same = {r.n: r.v for r in T.resample(a, a.drop("v"), ["morphology"], order="n", value="v").collect()}
    assert same == {1: 1.0, 2: 3.0, 3: 9.0}
    other = {r.n: r.v for r in T.resample(a, b, ["morphology"], order="n", value="v").collect()}
    assert other == {1: 1.0, 2: 2.0, 3: 9.0}


def test_trees_without_an_origin_or_position_stay(spark):
    points = spark.createDataFrame(
        [("a", 1, 1.0, 2.0, 3.0), ("b", 1, 4.0, 5.0, 6.0)], "morphology string, point_id long, x double, y double, z double"
    )
    origin = points.filter("morphology = 'a'").drop("point_id")
    moved = {r["morphology"]: (r["x"], r["y"], r["z"]) for r in T.recenter(points, origin).collect()}
    assert moved == {"a": (0.0, 0.0, 0.0), "b": (4.0, 5.0, 6.0)}
    home = spark.createDataFrame([("b", 10.0, 0.0, -6.0)], "morphology string, atlas_x double, atlas_y double, atlas_z double")
    moved = {r["morphology"]: (r["x"], r["y"], r["z"]) for r in T.translate(points, home).collect()}
    assert moved == {"a": (1.0, 2.0, 3.0), "b": (14.0, 5.0, 0.0)}
    assert [r[0] for r in T.unplaced(points, home).collect()] == ["a"]
