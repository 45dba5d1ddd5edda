"""Comparison of two collections: length maps, their differences, morphometric scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators.core import numbered
from arborframe.operators.voxels import IJK

SIZE = ("dim_x", "dim_y", "dim_z")


def match_maps(ref: DataFrame, comp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full match of two grid tables: (keys, found) with where each entry occurs.

    ``found`` is ``both``, ``in reference only`` or ``in compared only``.
    """
    keys = list(keys)
    a = ref.select(*keys).distinct().withColumn("_r", F.lit(True))
    b = comp.select(*keys).distinct().withColumn("_c", F.lit(True))
    found = (
        F.when(F.col("_r").isNull(), F.lit("in compared only"))
        .when(F.col("_c").isNull(), F.lit("in reference only"))
        .otherwise(F.lit("both"))
    )
    return a.join(b, keys, "full_outer").select(*keys, found.alias("found"))


def inconsistent_sizes(ref: DataFrame, comp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched grids whose voxel sizes differ; must be empty."""
    keys = list(keys)
    b = comp.select(*keys, *[F.col(c).alias(f"_{c}") for c in SIZE])
    differ = F.lit(False)
    for c in SIZE:
        differ = differ | (F.abs(F.col(c) - F.col(f"_{c}")) > 1e-8 + 1e-5 * F.abs(F.col(f"_{c}")))
    return ref.join(b, keys).filter(differ).select(*keys)


def aligned_grids(ref: DataFrame, comp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far each map moves on the grid that covers both, and that grid's voxel count.

    Returns (keys, r_x .. r_z, c_x .. c_z, n_voxels): whole-voxel paddings below each map.
    """
    keys = list(keys)
    b = comp.select(*keys, *[F.col(f"{p}_{a}").alias(f"_{p}_{a}") for p in ("off", "n") for a in geo.AXES])
    both = ref.join(b, keys)
    out, count = both, F.lit(1).cast("bigint")
    for a in geo.AXES:
        dim = F.col(f"dim_{a}")
        low = F.least(f"off_{a}", f"_off_{a}")
        high = F.greatest(
            F.col(f"off_{a}") + F.col(f"n_{a}") * dim, F.col(f"_off_{a}") + F.col(f"_n_{a}") * dim
        )
        out = out.withColumn(f"r_{a}", F.round((F.col(f"off_{a}") - low) / dim).cast("int"))
        out = out.withColumn(f"c_{a}", F.round((F.col(f"_off_{a}") - low) / dim).cast("int"))
        above = F.round((high - F.col(f"off_{a}") - F.col(f"n_{a}") * dim) / dim).cast("int")
        count = count * (F.col(f"n_{a}") + F.col(f"r_{a}") + above)
    return out.withColumn("n_voxels", count).select(
        *keys, *[f"{p}_{a}" for p in "rc" for a in geo.AXES], "n_voxels"
    )


def map_difference(
    ref_map: DataFrame, comp_map: DataFrame, shifts: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Sparse difference of two aligned maps: (keys, i, j, k, ref, comp, diff, n_voxels)."""
    keys = list(keys)

    def placed(df: DataFrame, side: str, name: str) -> DataFrame:
        moved = df.join(shifts, keys)
        return moved.select(
            *keys, *[(F.col(n) + F.col(f"{side}_{a}")).alias(n) for n, a in zip(IJK, geo.AXES)],
            F.col("length").alias(name),
        )

    both = placed(ref_map, "r", "ref").join(placed(comp_map, "c", "comp"), [*keys, *IJK], "full_outer")
    filled = both.withColumn("ref", F.coalesce("ref", F.lit(0.0))).withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    return filled.withColumn("diff", F.col("ref") - F.col("comp")).join(shifts.select(*keys, "n_voxels"), keys)


def difference_stats(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of the absolute difference over every voxel of the grid, zeros included."""
    d = F.abs(F.col("diff"))
    sums = diff.groupBy(*keys).agg(
        F.sum(d).alias("_d1"), F.sum(d * d).alias("_d2"),
        (F.sum(F.abs("ref")) + F.sum(F.abs("comp"))).alias("_t1"),
        (F.sum(F.col("ref") * F.col("ref")) + F.sum(F.col("comp") * F.col("comp"))).alias("_t2"),
        F.min(d).alias("_min"), F.max(d).alias("_max"), F.count(F.lit(1)).alias("_rows"),
        F.first("n_voxels").alias("_n"),
    )
    mean = F.col("_d1") / F.col("_n")
    spread = F.greatest(F.lit(0.0), F.col("_d2") / F.col("_n") - mean * mean)
    return sums.select(
        *keys,
        F.try_divide("_d1", "_t1").alias("l1"),
        F.sqrt(F.try_divide("_d2", "_t2")).alias("l2"),
        F.col("_d1").alias("sum"), mean.alias("mean"),
        F.when(F.col("_rows") < F.col("_n"), F.lit(0.0)).otherwise(F.col("_min")).alias("min"),
        F.col("_max").alias("max"), F.sqrt(spread).alias("std"),
    )


def long_features(wide: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Morphometric table as rows (owner, feature, value)."""
    names = [c for c in wide.columns if c not in owner]
    return wide.unpivot(list(owner), names, "feature", "value")


def relative_scores(ref: DataFrame, test: DataFrame, owner: Sequence[str]) -> DataFrame:
    """(test - ref) / ref per feature: 0 for 0 / 0, NaN where an input is missing.

    A zero reference gives an infinity with the sign of the test value.
    """
    owner = list(owner)
    b = test.withColumnRenamed("value", "_test")
    a, t = F.col("value"), F.col("_test")
    missing = a.isNull() | t.isNull() | F.isnan(a) | F.isnan(t)
    at_zero = F.when(t == 0, F.lit(0.0)).when(t > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    # a NaN quotient (infinity over infinity) counts as 0
    quotient = F.nanvl(F.try_divide(t - a, a), F.lit(0.0))
    return ref.join(b, [*owner, "feature"]).select(
        *owner, "feature",
        F.when(missing, F.lit(float("nan"))).when(a == 0, at_zero).otherwise(quotient).alias("score"),
    )


def paired(ref: DataFrame, test: DataFrame, *, name: str = "morphology", order: str = "order") -> DataFrame:
    """Reference and test morphologies paired by position: (pair, ref_name, test_name, ok).

    ``ok`` is false where one side is missing or the types (column ``mtype``) differ.
    """
    a = numbered(ref.withColumn("_all", F.lit(1)), ["_all"], order, "pair").select(
        "pair", F.col(name).alias("ref_name"), F.col("mtype").alias("_rt"))
    b = numbered(test.withColumn("_all", F.lit(1)), ["_all"], order, "pair").select(
        "pair", F.col(name).alias("test_name"), F.col("mtype").alias("_tt"))
    return a.join(b, "pair", "full_outer").select(
        "pair", "ref_name", "test_name", F.coalesce(F.col("_rt") == F.col("_tt"), F.lit(False)).alias("ok")
    )


def score_summary(scores: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the absolute scores clipped to [0, 1]; NaN left out."""
    clipped = F.when(~F.isnan("score"), F.least(F.abs("score"), F.lit(1.0)))
    return scores.groupBy(*owner).agg(
        F.avg(clipped).alias("mean_score"), F.stddev_pop(clipped).alias("std_score"),
        F.count(F.lit(1)).alias("n_scores"),
    )


def score_matrix(scores: DataFrame, owner: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per morphology and one column per feature."""
    return scores.groupBy(*owner).pivot("feature", list(features)).agg(F.first("score"))


def unequal_features(scores: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Owners whose feature list differs from the longest one; must be empty."""
    every = scores.select("feature").distinct().agg(F.count(F.lit(1))).scalar()
    return scores.groupBy(*owner).agg(F.count_distinct("feature").alias("n")).filter(F.col("n") != every)


def workflow_counts(results: DataFrame, workflows: Sequence[str]) -> DataFrame:
    """Successes and failures per workflow; a workflow fails where its path is NULL."""
    long = results.select(
        F.explode(F.array(*[
            F.struct(F.lit(w).alias("workflow"), F.col(f"synthesized_{w}_path").isNotNull().alias("_ok"))
            for w in workflows
        ])).alias("_w")
    ).select("_w.*")
    return long.groupBy("workflow").agg(
        F.count(F.when(F.col("_ok"), 1)).alias("n_success"), F.count(F.when(~F.col("_ok"), 1)).alias("n_failed")
    )
