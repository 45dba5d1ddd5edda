import pytest
from pyspark.sql import functions as F

from arborframe.operators import compare as D
from arborframe.operators import regions as R
from arborframe.operators import voxels as V

# runs of regions: (regions, parameters of the borders, expected regions, expected borders)
RUNS = {
    "two regions": ([1, 2], [0, 0.5, 1], [1, 2], [(0, 0.5), (0.5, 1)]),
    "first repeated": ([1, 1, 2], [0, 0.25, 0.5, 1], [1, 2], [(0, 0.5), (0.5, 1)]),
    "second repeated": ([1, 2, 2], [0, 0.5, 0.75, 1], [1, 2], [(0, 0.5), (0.5, 1)]),
    "both repeated": ([1, 1, 2, 2], [0, 0.25, 0.5, 0.75, 1], [1, 2], [(0, 0.5), (0.5, 1)]),
    "three regions": ([1, 2, 3], [0, 0.5, 0.75, 1], [1, 2, 3], [(0, 0.5), (0.5, 0.75), (0.75, 1)]),
    "three, first repeated": ([1, 1, 2, 3], [0, 0.25, 0.5, 0.75, 1], [1, 2, 3], [(0, 0.5), (0.5, 0.75), (0.75, 1)]),
    "three, second empty": ([1, 1, 2, 3], [0, 0.25, 0.5, 0.5, 1], [1, 3], [(0, 0.5), (0.5, 1)]),
    "one repeated": ([1, 1], [0, 0.5, 1], [1], [(0, 1)]),
    "one repeated, empty": ([1, 1], [0, 0, 0], [], []),
    "nothing": ([], [0], [], []),
    "one region": ([1], [0, 1], [1], [(0, 1)]),
}


def test_run_merge_forwards_and_backwards(spark):
    rows = []
    for name, (regions, cuts, _, _) in RUNS.items():
        spans = list(zip(cuts[:-1], cuts[1:]))
        for n, (r, (a, b)) in enumerate(zip(regions, spans)):
            rows.append((name, n, r, float(a), 0.0, 0.0, float(b), 0.0, 0.0))
        for n, (r, (a, b)) in enumerate(zip(regions[::-1], spans[::-1])):
            rows.append((name + " reversed", n, r, float(b), 0.0, 0.0, float(a), 0.0, 0.0))
    df = spark.createDataFrame(rows, "s string, piece int, region_id long, px0 double, py0 double, pz0 double, px1 double, py1 double, pz1 double")
    got = {}
    for r in V.merge_runs(df, ["s"]).orderBy("run").collect():
        got.setdefault(r.s, []).append((r.region_id, r.x0, r.x1))
    for name, (_, _, regions, borders) in RUNS.items():
        want = [(r, float(a), float(b)) for r, (a, b) in zip(regions, borders)]
        assert got.get(name, []) == want, name
        assert got.get(name + " reversed", []) == [(r, b, a) for r, a, b in want[::-1]], name


@pytest.mark.parametrize(
    ("start", "end", "regions"),
    [((0, 0, 0), (0, 0, 0), []), ((0, 0, 0), (10, 20, 0), [20]), ((-10, 0, 0), (10, 0, 0), [2, 20]),
     ((-10, 0, 0), (500, 0, 0), [2, 20]), ((-500, 0, 0), (10, 0, 0), [2, 20]), ((-500, 0, 0), (500, 0, 0), [2, 20])],
)
def test_segments_through_two_regions(spark, start, end, regions):
    grid = V.Grid((100.0,) * 3, (-1100.0, 0.0, -100.0), (22, 8, 2))
    seg = spark.createDataFrame([("s", *map(float, start), *map(float, end))], "s string, x_from double, y_from double, z_from double, x_to double, y_to double, z_to double")
    cells = spark.range(22).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    cells = cells.withColumn("region_id", F.when(F.col("i") >= 11, 20).otherwise(2).cast("long"))
    pieces = V.grid_pieces(seg, grid).join(cells, ["i", "j", "k"], "left")
    runs = V.merge_runs(pieces, ["s"]).orderBy("run").collect()
    assert [r.region_id for r in runs] == regions
    if regions:
        assert (runs[0].x0, runs[0].y0, runs[0].z0) == tuple(map(float, start))
        assert (runs[-1].x1, runs[-1].y1, runs[-1].z1) == tuple(map(float, end))


def test_lengths_are_conserved(spark):
    grid = V.Grid((3.0, 4.0, 5.0), (-100.0,) * 3, (100,) * 3)
    seg = spark.range(200).select("id", *[((F.rand(n + 1) - 0.5) * 60).alias(c) for n, c in enumerate(["x_from", "y_from", "z_from", "x_to", "y_to", "z_to"])]).cache()
    whole = seg.select(F.sum(F.sqrt(sum(((F.col(f"{a}_to") - F.col(f"{a}_from")) ** 2 for a in "xyz"), F.lit(0))))).first()[0]
    cut = V.length_per_voxel(seg, ["id"], grid).agg(F.sum("length")).first()[0]
    assert abs(whole - cut) < 1e-6


REGIONS = [(1, -1, "root", "all"), (2, 1, "a", "A"), (3, 1, "b", "B"), (4, 3, "c", "5"), (5, 4, "d", "B")]


def test_hierarchy(spark):
    reg = spark.createDataFrame(REGIONS, "id long, parent_id long, acronym string, name string")
    assert {r.id: r.st_level for r in R.with_level(reg).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    down = R.descendants(reg)
    assert sorted(r.youth_id for r in down.collect() if r.id == 3) == [3, 4, 5]
    asked = spark.createDataFrame([("B",), ("2",), ("5",), ("zz",), ("77",)], "key string")
    found, missing = R.resolve(asked, reg, None)
    # "5" reads as a number, so it is an id and not the name of region 4
    assert sorted(r.id for r in found.collect()) == [2, 3, 5]
    assert sorted(r.key for r in missing.collect()) == ["77", "zz"]
    vox = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 2), (2, 0, 0, 77)], "i int, j int, k int, region_id long")
    found, missing = R.resolve(asked.filter("key in ('b', '77')").unionByName(spark.createDataFrame([("b",)], "key string")), reg, down)
    inside = R.voxels_in(vox, found, missing).collect()
    assert sorted(r.i for r in inside) == [0, 2]
    up = R.ascendants(reg)
    known = spark.createDataFrame([(3,)], "id long")
    ask = spark.createDataFrame([(5,), (2,), (0,), (-1,)], "id long")
    assert {r.id: r.nested_id for r in R.first_nested(ask, known, up).collect()} == {5: 3, 2: 2, 0: 0, -1: -1}


def test_difference_counts_empty_voxels(spark):
    diff = spark.createDataFrame([("m", 2.0, 1.0, 1.0, 10), ("m", 0.0, 3.0, -3.0, 10)], "m string, ref double, comp double, diff double, n_voxels long")
    r = D.difference_stats(diff, ["m"]).first()
    assert (r["sum"], r["mean"], r["min"], r["max"]) == (4.0, 0.4, 0.0, 3.0)
    assert abs(r.l1 - 4 / 6) < 1e-12 and abs(r.std - (1.0 - 0.16) ** 0.5) < 1e-12


def test_scores_at_zero_and_missing(spark):
    ref = spark.createDataFrame([("m", "a", 2.0), ("m", "b", 0.0), ("m", "c", 0.0), ("m", "d", None)], "m string, feature string, value double")
    test = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 0.0), ("m", "c", -1.0), ("m", "d", 1.0)], "m string, feature string, value double")
    got = {r.feature: r.score for r in D.relative_scores(ref, test, ["m"]).collect()}
    assert got["a"] == 0.5 and got["b"] == 0.0 and got["c"] == float("-inf") and got["d"] != got["d"]


def cut_tree(spark):
    """Tree ``t``: 0 - 1 - 4 along the first axis through regions 1, 2, 3 and back; 0 - 2 - 3."""
    at = {0: (5.0, 0, 0, False), 1: (25.0, 1, 0, False), 2: (8.0, 2, 0, False), 3: (8.0, 2, 1, True), 4: (15.0, 1, 1, True)}
    nodes = spark.createDataFrame(
        [("t", n, x, 5.0, 5.0, end, section, place) for n, (x, section, place, end) in at.items()],
        "tree string, id long, x double, y double, z double, is_terminal boolean, section_id long, sub_segment_num long",
    )
    edges = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("t", 2, 3), ("t", 1, 4)], "tree string, source long, target long")
    voxels = spark.createDataFrame([(i, 0, 0, i + 1) for i in range(3)], "i int, j int, k int, region_id long")
    return V.cut_edges(nodes, edges, voxels, V.Grid(dim=(10.0,) * 3, offset=(0.0,) * 3, shape=(3, 1, 1)), ["tree"])


def test_edges_cut_at_borders(spark):
    nodes, edges = cut_tree(spark)
    assert sorted(map(tuple, edges.select("source", "target", "region_id").collect())) == [
        (0, 2, 1), (0, 5, 1), (1, 7, 3), (2, 3, -1), (5, 6, 2), (6, 1, 3), (7, 4, 2),
    ]
    got = nodes.select("id", "x", "section_id", "sub_segment_num", "is_intermediate_pt").collect()
    assert sorted(map(tuple, got)) == [
        (0, 5.0, 0, 0, False), (1, 25.0, 1, 2, False), (2, 8.0, 2, 0, False), (3, 8.0, 2, 1, False),
        (4, 15.0, 1, 4, False), (5, 10.0, 1, 0, True), (6, 20.0, 1, 1, True), (7, 20.0, 1, 3, True),
    ]


def test_runs_meet_one_row_of_their_edge(spark):
    """The pieces are ten times the edges; only joins with a row for each edge are made of them."""
    _, edges = cut_tree(spark)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
