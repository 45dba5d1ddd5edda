import hashlib
import random

from pyspark.sql import functions as F

from arborframe.functions.draws import seed_from_name, uniform
from arborframe.operators import batches, core


def test_accumulate_over_slices_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", n, rng.randrange(100)) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n long, v long")
    got = core.accumulate(df, ["g"], ["n"], slice_by=core.id_slice("n", 7), number="rn", sums={"s": F.col("v")})
    seen, sums, want = {}, {}, set()
    for g, n, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        sums[g] = sums.get(g, 0) + v
        want.add((g, n, seen[g], sums[g]))
    assert {(r.g, r.n, r.rn, r.s) for r in got.collect()} == want


def test_accumulate_without_keys(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("n"))
    got = core.accumulate(df, [], ["n"], slice_by=core.id_slice("n", 10), number="rn")
    assert sorted((r.n, r.rn) for r in got.collect()) == [(3 * i, i + 1) for i in range(100)]


def test_weighted_pick_gives_every_request_one_option(spark):
    options = spark.createDataFrame(
        [("a", n, float(n % 5) / 3, f"o{n}") for n in range(200)] + [("b", 1000, 2.0, "only")],
        "k string, n long, w double, name string",
    )
    asks = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"))
    got = core.weighted_pick(asks, options, ["k"], draw=uniform("id"), weight="w", order="n", payload=["name"]).collect()
    assert len(got) == 3000 and len({r.id for r in got}) == 3000
    assert all((r.name == "only") == (r.k == "b") for r in got)
    # options without weight are never drawn, heavy ones about twice as often as light ones
    picks = [int(r.name[1:]) for r in got if r.k == "a"]
    assert all(n % 5 for n in picks)
    light, heavy = sum(n % 5 == 1 for n in picks), sum(n % 5 == 4 for n in picks)
    assert 3.0 < heavy / light < 5.5


def test_seed_equals_the_big_integer(spark):
    names = ["", "a", "morph_0001", "très long"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", seed_from_name("n").alias("s")).collect()
    for r in rows:
        assert r.s == int(hashlib.sha256(r.n.encode()).hexdigest(), 16) % (2**32 - 1)


def test_written_tables_go_to_the_named_folder(spark):
    root = core.scratch_root(spark)
    out = core.written(spark.range(5), "t")
    assert out.inputFiles()[0].replace("file://", "").startswith(root.replace("file:", ""))


def test_a_bad_row_spoils_only_itself(spark):
    def root(frame):
        if (frame["v"] < 0).any():
            raise ValueError("negative")
        return frame.assign(r=frame["v"] ** 0.5)

    out = batches.apply_rows(spark.createDataFrame([(1, 4.0), (2, -1.0), (3, 9.0)], "id long, v double"), root, {"r": "double"})
    good, bad = batches.split_failures(out)
    assert sorted((r.id, r.r) for r in good.collect()) == [(1, 2.0), (3, 3.0)]
    assert [(r.id, r.error) for r in bad.collect()] == [(2, "ValueError: negative")]


def test_small_groups_are_dealt_over_all_cores(spark):
    """A write of one file a group is not left to a few tasks because its rows are few."""
    df = spark.range(400).select((F.col("id") % 200).alias("g"), "id")
    out = core.dealt(df, ["g"]).withColumn("_p", F.spark_partition_id())
    per = out.groupBy("g").agg(F.count_distinct("_p").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(per) == 200 and {(r["n"], r["rows"]) for r in per} == {(1, 2)}
    assert out.select("_p").distinct().count() > spark.sparkContext.defaultParallelism
