"""Shape measures of trees: angles, trunk statistics, barcodes, morphometric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators.contraction import climb, is_root
from arborframe.operators.core import written
from arborframe.operators.trees import fold, section_measures, with_parent_point

FROM, TO = geo.triple("", "_from"), geo.triple("", "_to")

# The features of the default score list with their modes.
FEATURES = {
    "number_of_bifurcations": ["sum"],
    "number_of_sections_per_neurite": ["mean", "sum"],
    "number_of_leaves": ["sum"],
    "partition_asymmetry": ["mean", "sum"],
    "partition_asymmetry_length": ["mean", "sum"],
    "remote_bifurcation_angles": ["mean"],
    "section_bif_branch_orders": ["max", "mean"],
    "section_bif_lengths": ["min", "max", "mean"],
    "section_bif_radial_distances": ["max", "mean"],
    "section_branch_orders": ["max", "mean"],
    "section_lengths": ["min", "max", "mean", "sum"],
    "section_path_distances": ["min", "max", "mean"],
    "section_radial_distances": ["min", "max", "mean"],
    "section_strahler_orders": ["mean"],
    "section_term_branch_orders": ["max", "mean"],
    "section_term_lengths": ["min", "max", "mean"],
    "section_term_radial_distances": ["max", "mean"],
    "section_tortuosity": ["min", "max", "mean"],
    "total_length_per_neurite": ["mean"],
}


def segment_angles(
    sectioned: DataFrame, keys: Sequence[str], *, reference: Sequence[float] = (0.0, 1.0, 0.0)
) -> DataFrame:
    """Angle of every segment (from parent to point) against a reference direction."""
    seg = with_parent_point(sectioned, keys)
    ref = [F.lit(float(r)) for r in reference]
    return seg.withColumn("angle", geo.angle(geo.vector(FROM, TO), ref))


def meander_angles(sectioned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle at every inner point of a section between the ways back and ahead.

    A point inside a section has exactly one child, so the way ahead is a join by parent id.
    Straight ahead is pi.
    """
    keys = list(keys)
    back = with_parent_point(sectioned, keys).filter("n_children = 1")
    ahead = sectioned.select(
        *keys, F.col("parent_id").alias("point_id"), *[F.col(a).alias(f"{a}_next") for a in geo.AXES]
    )
    here = list(geo.AXES)
    angle = geo.angle(geo.vector(here, FROM), geo.vector(here, geo.triple("", "_next")))
    return back.join(ahead, [*keys, "point_id"]).withColumn("angle", angle)


def trunk_properties(sectioned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of segment lengths and meander angles per tree."""
    keys = list(keys)
    lengths = with_parent_point(sectioned, keys).groupBy(*keys).agg(
        F.avg(geo.distance(FROM, TO)).alias("mean_segment_lengths"),
        F.stddev_pop(geo.distance(FROM, TO)).alias("std_segment_lengths"),
    )
    angles = meander_angles(sectioned, keys).groupBy(*keys).agg(
        F.avg("angle").alias("mean_segment_meander_angles"),
        F.stddev_pop("angle").alias("std_segment_meander_angles"),
    )
    return lengths.join(angles, keys, "left")


def barcodes(section_table: DataFrame, keys: Sequence[str], *, metric: str = "path_distance") -> DataFrame:
    """Persistence bars of a tree: one per leaf, (keys, section_id, birth, death).

    A bar is born at the farthest leaf below the section that starts it and dies at the branch
    where a sibling with a farther leaf goes on; the farthest of all dies at 0.  The distance is
    that of the leaf along the path or, with ``radial_distance``, in a straight line.
    """
    keys = list(keys)
    measured = written(section_measures(section_table, keys), "barcode-sections")
    if metric == "path_distance":
        top = measured.withColumn("_top", F.col("max_path_extent"))
    else:
        below = fold(
            measured, keys, node="section_id", parent="parent_section_id",
            below={"_top": ("max", F.when(F.col("is_leaf"), F.col(metric)).otherwise(F.lit(0.0)))},
        )
        top = measured.join(below, [*keys, "section_id"])
    ends = measured.select(
        *keys, F.col("section_id").alias("parent_section_id"), F.col(metric).alias("_end")
    )
    best = top.groupBy(*keys, "parent_section_id").agg(
        F.max_by("section_id", F.struct("_top", -F.col("section_id"))).alias("_heir")
    )
    # the heir of a branch goes on with the bar of its parent; all others start one
    return (
        top.join(best, [*keys, "parent_section_id"])
        .filter((F.col("parent_section_id") == -1) | (F.col("section_id") != F.col("_heir")))
        .join(ends, [*keys, "parent_section_id"], "left")
        .select(*keys, "section_id", F.col("_top").alias("birth"), F.coalesce("_end", F.lit(0.0)).alias("death"))
    )


def strahler_orders(section_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strahler order per section: (keys, section_id, strahler).

    A section reaches order n + 1 when it or one below it has two children of order n or more.
    Trees of one piece are settled there; those of several pieces order by order.
    """
    keys = list(keys)
    found = climb(
        section_table, keys, node="section_id", orders="strahler",
        parent=F.when(~is_root("parent_section_id"), F.col("parent_section_id")),
    ).select(*keys, "section_id", F.col("strahler").cast("int").alias("strahler"))
    split = found.filter(F.col("strahler").isNull()).select(*keys, "section_id")
    if split.isEmpty():
        return found
    rest = section_table.join(split, [*keys, "section_id"], "left_semi")
    return found.filter(F.col("strahler").isNotNull()).unionByName(_orders_by_level(rest, keys))


def _orders_by_level(section_table: DataFrame, keys: list[str]) -> DataFrame:
    """The same by folds of whole trees: each settles one order on the sections that reached the
    one before, whose number at least halves."""
    level = written(section_table.select(*keys, "section_id", "parent_section_id"), "strahler")
    found = level.select(*keys, "section_id", F.lit(1).alias("strahler"))
    order = 1
    while True:
        forks = level.filter("parent_section_id <> -1").groupBy(
            *keys, F.col("parent_section_id").alias("section_id")
        ).agg(F.count(F.lit(1)).alias("_kids")).filter("_kids >= 2").withColumn("_fork", F.lit(1))
        flagged = level.join(forks.select(*keys, "section_id", "_fork"), [*keys, "section_id"], "left")
        below = fold(
            flagged, keys, node="section_id", parent="parent_section_id",
            below={"_any": ("max", F.coalesce("_fork", F.lit(0)))},
        ).filter("_any = 1")
        level = written(level.join(below, [*keys, "section_id"], "left_semi"), "strahler")
        if level.isEmpty():
            break
        order += 1
        found = found.unionByName(level.select(*keys, "section_id", F.lit(order).alias("strahler")))
    return found.groupBy(*keys, "section_id").agg(F.max("strahler").alias("strahler"))


def section_features(section_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Section table with every quantity the morphometric features are made of."""
    keys = list(keys)
    measured = written(section_measures(section_table, keys), "feature-sections")
    counted = fold(
        measured, keys, node="section_id", parent="parent_section_id",
        up={"_depth": F.lit(1)}, below={"n_below": ("sum", F.lit(1))},
    )
    base = written(measured.join(counted, [*keys, "section_id"]), "feature-counts")
    total = base.groupBy(*keys).agg(F.sum("length").alias("_total"))
    ends = F.struct(F.col("section_id"), F.col("n_below"), F.col("path_length"), *[F.col(f"{a}_last") for a in geo.AXES])
    kids = base.filter("parent_section_id <> -1").groupBy(
        *keys, F.col("parent_section_id").alias("section_id")
    ).agg(F.min(ends).alias("_a"), F.max(ends).alias("_b"))
    out = base.join(kids, [*keys, "section_id"], "left").join(total, keys)
    here = geo.triple("", "_last")

    def toward(kid: str) -> list[Column]:
        return geo.vector(here, [F.col(f"{kid}.{c}") for c in here])

    a, b = F.col("_a.n_below"), F.col("_b.n_below")
    is_bif = F.col("n_children") == 2
    straight = geo.distance(geo.triple("", "_first"), here)
    return out.select(
        *keys, "section_id", "parent_section_id", "is_leaf", is_bif.alias("is_bif"), "length",
        "path_distance", "radial_distance", (F.col("_depth") - 1).alias("branch_order"),
        F.when(is_bif, F.abs(a - b) / (a + b)).alias("asymmetry"),
        F.when(is_bif, F.try_divide(F.abs(F.col("_a.path_length") - F.col("_b.path_length")), F.col("_total"))).alias("asymmetry_length"),
        F.when(is_bif, geo.angle(toward("_a"), toward("_b"))).alias("bif_angle"),
        F.try_divide(F.col("length"), straight).alias("tortuosity"),
    )


def morphometrics(
    section_table: DataFrame, owner: Sequence[str], neurite: Sequence[str], *, strahler: bool = True
) -> DataFrame:
    """Morphometric features per morphology and neurite type, as one wide row.

    ``owner`` names the columns of the result's key (morphology, type), ``neurite`` those that
    tell neurites of an owner apart.  Column names are mode and feature, ``mean_section_lengths``.
    """
    owner, keys = list(owner), [*owner, *neurite]
    sec = section_features(section_table, keys)
    if strahler:
        sec = sec.join(strahler_orders(section_table, keys), [*keys, "section_id"])
    per = sec.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_len"))
    neurites = per.groupBy(*owner).agg(
        F.avg("_n").alias("mean_number_of_sections_per_neurite"),
        F.sum("_n").cast("double").alias("sum_number_of_sections_per_neurite"),
        F.avg("_len").alias("mean_total_length_per_neurite"),
    )
    bif, leaf = F.col("is_bif"), F.col("is_leaf")
    source = {
        "partition_asymmetry": F.col("asymmetry"),
        "partition_asymmetry_length": F.col("asymmetry_length"),
        "remote_bifurcation_angles": F.col("bif_angle"),
        "section_bif_branch_orders": F.when(bif, F.col("branch_order")),
        "section_bif_lengths": F.when(bif, F.col("length")),
        "section_bif_radial_distances": F.when(bif, F.col("radial_distance")),
        "section_branch_orders": F.col("branch_order"),
        "section_lengths": F.col("length"),
        "section_path_distances": F.col("path_distance"),
        "section_radial_distances": F.col("radial_distance"),
        "section_term_branch_orders": F.when(leaf, F.col("branch_order")),
        "section_term_lengths": F.when(leaf, F.col("length")),
        "section_term_radial_distances": F.when(leaf, F.col("radial_distance")),
        "section_tortuosity": F.col("tortuosity"),
    }
    if strahler:
        source["section_strahler_orders"] = F.col("strahler")
    modes = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    aggs = [
        F.sum(bif.cast("int")).cast("double").alias("sum_number_of_bifurcations"),
        F.sum(leaf.cast("int")).cast("double").alias("sum_number_of_leaves"),
    ]
    for name, value in source.items():
        aggs += [modes[m](value).cast("double").alias(f"{m}_{name}") for m in FEATURES[name]]
    return sec.groupBy(*owner).agg(*aggs).join(neurites, owner)
