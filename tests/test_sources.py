import math

import pytest
from pyspark.sql import functions as F

from arborframe.operators import sampling as P
from arborframe.operators import voxels as V
from arborframe.sources import documents as X
from arborframe.sources import morphologies as N
from arborframe.sources import tables as K


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "b.swc").write_text("# header\n1 1 1.0 2.0 3.0 0.5 -1 # soma\n\n2 2 4 5 6 0.1 1\n")
    (tmp_path / "deep" / "a.swc").write_text(" 1 1 0 0 0 1 -1\n")
    (tmp_path / "deep" / "er" / "c.asc").write_text("x")
    (tmp_path / "b.asc").write_text("x")
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_listing_and_depth(spark, folder):
    every = {(r.morphology, r.suffix) for r in N.list_files(spark, folder).collect()}
    assert every == {("b", ".swc"), ("b", ".asc"), ("deep/a", ".swc"), ("deep/er/c", ".asc")}
    assert {r.morphology for r in N.list_files(spark, folder, max_level=1).collect()} == {"b", "deep/a"}


def test_point_tables_and_cells(spark, folder):
    pts = N.read_points(spark, folder)
    rows = {(r.morphology, r.point_id): (r.type, r.x, r.z, r.parent_id) for r in pts.collect()}
    assert rows == {("b", 1): (1, 1.0, 3.0, -1), ("b", 2): (2, 4.0, 6.0, 1), ("deep/a", 1): (1, 0.0, 0.0, -1)}
    cells = {r.morphology: r for r in N.cell_collection(pts).collect()}
    assert (cells["b"]["index"], cells["deep/a"]["index"]) == (1, 2)
    assert (cells["b"].x, cells["b"].atlas_x) == (0.0, 1.0)
    assert N.cell_collection(pts, recenter=False).filter("morphology = 'b'").first().x == 1.0


def test_files_of_cells(spark, folder):
    cells = spark.createDataFrame([("b",), ("deep/a",), ("nope",)], "morphology string")
    found, missing = N.attach_files(cells, N.list_files(spark, folder))
    assert {r.morphology: r.morph_file.rsplit(".", 1)[1] for r in found.collect()} == {"b": "swc", "deep/a": "swc"}
    with pytest.raises(FileNotFoundError, match="nope"):
        N.require_files(missing)


def test_recipe_takes_one_region_or_a_list(spark):
    body = '{"populations":[{"name":"a","atlas_region":{"name":"r","subregions":["l1"]}},{"name":"b","atlas_region":[{"name":"r"},{"name":"s"}]}]}'
    pops = X.read_recipe(spark.createDataFrame([(body,)], "body string"))["populations"].collect()
    assert {p.name: [(a.name, a.subregions) for a in p.atlas_region] for p in pops} == {"a": [("r", ["l1"])], "b": [("r", None), ("s", None)]}


def test_nested_regions_of_any_depth(spark):
    body = '{"id":1,"acronym":"r","name":"R","children":[{"id":2,"acronym":"a","name":"A","children":[{"id":3,"acronym":"b","name":"B"}]},{"id":4,"acronym":"c","name":"C","children":[]}]}'
    rows = X.read_hierarchy(spark.createDataFrame([(body,)], "body string")).collect()
    assert {(r.id, r.parent_id, r.st_level) for r in rows} == {(1, -1, 0), (2, 1, 1), (3, 2, 2), (4, 1, 1)}


def test_keyed_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", None), ("b", 3.0)], "morphology string, grafting_section_id double").write.parquet(path)
    got = K.read_keyed(spark, path, required=["morphology"], section_column="grafting_section_id")
    assert {r.morphology: r.grafting_section_id for r in got.collect()} == {"a": -1, "b": 3}
    with pytest.raises(ValueError, match="zz"):
        K.read_keyed(spark, path, required=["zz"])
    nan = K.nan_to_null(spark.createDataFrame([(math.nan,), (1.0,)], "v double"))
    assert sorted((r.v for r in nan.collect()), key=str) == [1.0, None]


def test_retries_stop_at_the_first_round_with_a_hit(spark):
    rows = [("m", 0, f"t{n}", p) for n, p in enumerate((0.0, 1e-9, 1.0))] + [("n", 0, "t", -1.0)]
    df = spark.createDataFrame(rows, "morphology string, axon_id long, target_population_id string, target_probability double")
    picked, none = P.pick_targets(df, request=["morphology", "axon_id", "target_population_id"])
    assert [r.target_population_id for r in picked.collect()] == ["t2"]
    assert [(r.morphology, r.axon_id) for r in none.collect()] == [("n", 0)]


def test_existing_axons(spark):
    ex = spark.createDataFrame([("m", 0, 1.0, 0.0, 0.0), ("m", 1, 2.0, 0.0, 0.0)], "morphology string, axon_id long, source_x double, source_y double, source_z double")
    cells = spark.createDataFrame([("m", 1, 9.0, None, None, "k"), ("m", 7, 5.0, None, None, "k"), ], "morphology string, rebuilt_existing_axon_id long, source_x double, source_y double, source_z double, kind string")
    got = {(r.rebuilt_existing_axon_id, r.source_x, r.source_y) for r in P.combine_existing_axons(cells, ex).collect()}
    assert got == {(1, 9.0, 0.0), (0, 1.0, 0.0)}
    assert P.repeated_rebuild_ids(cells.unionByName(cells)).count() == 2
    plain = cells.select("morphology", "kind").distinct().unionByName(spark.createDataFrame([("other", "k")], "morphology string, kind string"))
    rows = P.combine_existing_axons(plain.withColumn("source_x", F.lit(None).cast("double")), ex).collect()
    assert sorted((r.morphology, r.source_x or 0.0) for r in rows) == [("m", 1.0), ("m", 2.0), ("other", 0.0)]


def test_positions_are_drawn_beside_each_row(spark):
    """Repeated rows stay as many as they are, columns named like coordinates keep their values."""
    grid = V.Grid((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (4, 4, 4))
    mask = spark.createDataFrame([(7, 1, 2, 3), (7, 2, 2, 3), (8, 0, 0, 0)], "target_brain_region_id long, i int, j int, k int")
    rows = spark.createDataFrame(
        [("m", 7, 9.0), ("m", 7, 9.0), ("n", 8, 9.0), ("o", 5, 9.0), ("p", None, 9.0)],
        "morphology string, target_brain_region_id long, x double")
    got = P.target_coordinates(rows, mask, grid, request=["morphology"]).collect()
    assert sorted(r.morphology for r in got) == ["m", "m", "n", "o", "p"]
    assert {r.x for r in got} == {9.0}
    at = {r.morphology: (r.target_x, r.target_y, r.target_z) for r in got}
    assert at["o"] == at["p"] == (None, None, None)
    assert all(0 <= c < 1 for c in at["n"]) and 1 <= at["m"][0] < 3 and 2 <= at["m"][1] < 3


def test_targets_of_an_axon_meet_in_one_exchange(spark):
    df = spark.range(20).select(
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("morphology"), (F.col("id") % 2).alias("axon_id"),
        F.col("id").cast("string").alias("target_population_id"), F.lit(0.3).alias("target_probability"))
    picked, _ = P.pick_targets(df, request=["morphology", "axon_id", "target_population_id"])
    plan = picked._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window") >= 1
