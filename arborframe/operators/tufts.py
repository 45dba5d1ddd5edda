"""Tufts of clusters: their own section tables, orientation, region, projection and barcode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import voxels as V
from arborframe.operators.clustering import cluster_properties, mean_tuft_length
from arborframe.operators.core import weighted_pick, written
from arborframe.operators.morphometrics import barcodes
from arborframe.operators.trees import resize_root_section, tuft_nodes

# Fixed value: the projection of a tuft whose region has none.
DEFAULT_POPULATION = "default"


def rotated(properties: DataFrame, field: DataFrame, grid: V.Grid) -> DataFrame:
    """Orientations turned by the rotation of the voxel of the common ancestor; those without a
    usable rotation stay."""
    at = [f"common_ancestor_{a}" for a in geo.AXES]
    found = V.orientations(properties, field, grid, coords=at)
    turned = [
        sum((F.col("rotation")[i][j] * F.col(f"u{b}") for j, b in enumerate(geo.AXES)), F.lit(0.0)).alias(f"u{a}")
        for i, a in enumerate(geo.AXES)
    ]
    rest = [c for c in properties.columns if c not in {f"u{a}" for a in geo.AXES}]
    return found.select(*rest, *turned)


def with_projections(
    properties: DataFrame, keys: Sequence[str], voxels: DataFrame, projections: DataFrame, grid: V.Grid, *,
    bouton_density: float, seed: str = "projection",
) -> DataFrame:
    """Adds ``region_id`` of the common ancestor, ``target_projection_name`` and
    ``mean_tuft_length``.

    ``projections``: (region_id, order, target_projection_name, pop_neuron_numbers, volume,
    fraction, strength).  One of those into the tuft's region is drawn, all with equal odds; the
    draw follows from the keys.  A tuft outside the grid has region 0, one without a projection
    the default name and no length.
    """
    keys = list(keys)
    at = [f"common_ancestor_{a}" for a in geo.AXES]
    placed = V.lookup(properties, voxels, grid, ["region_id"], coords=at)
    placed = written(placed.withColumn("region_id", F.coalesce("region_id", F.lit(0)).cast("bigint")), "tuft-regions")
    payload = ["target_projection_name", "pop_neuron_numbers", "volume", "fraction", "strength"]
    drawn = weighted_pick(
        placed.select(*keys, "tuft_id", "region_id"), projections.withColumn("_one", F.lit(1.0)), ["region_id"],
        draw=uniform(*keys, "tuft_id", F.lit(seed)), weight="_one", order="order", payload=payload,
    )
    length = mean_tuft_length(
        F.col("volume"), F.col("pop_neuron_numbers"), F.col("fraction"), F.col("strength"), F.lit(bouton_density)
    )
    return placed.join(drawn.drop("region_id"), [*keys, "tuft_id"], "left").select(
        *placed.columns, F.coalesce("target_projection_name", F.lit(DEFAULT_POPULATION)).alias("target_projection_name"),
        length.alias("mean_tuft_length"),
    )


def tuft_sections(
    section_table: DataFrame, members: DataFrame, properties: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The section table of every tuft, with ``tuft_id``: the sections from the common ancestor to
    the members, the ancestor shortened to a unit segment along the orientation."""
    keys, own = list(keys), [*keys, "tuft_id"]
    tops = properties.select(*own, F.col("common_ancestor_id").alias("section_id"))
    wanted = members.filter("tuft_id > 0").select(*own, "section_id").unionByName(tops)
    on = written(
        tuft_nodes(section_table, wanted, keys, ["tuft_id"], node="section_id", parent="parent_section_id"),
        "tuft-nodes",
    )
    rows = on.join(section_table.drop("n_children", "is_leaf"), [*keys, "section_id"]).withColumn(
        "parent_section_id",
        F.when(F.col("is_common_ancestor"), F.lit(-1)).otherwise(F.col("parent_section_id")).cast("bigint"),
    ).drop("is_common_ancestor")
    kids = rows.groupBy(*own, F.col("parent_section_id").alias("section_id")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = rows.join(kids, [*own, "section_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    turned = properties.select(*own, *[f"u{a}" for a in geo.AXES])
    return resize_root_section(rows.withColumn("is_leaf", F.col("n_children") == 0), turned, own)


def tuft_barcodes(tufts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of every tuft by path distance: (keys, tuft_id, section_id, birth, death)."""
    return barcodes(tufts, [*keys, "tuft_id"])


def complete_properties(
    section_table: DataFrame, members: DataFrame, clusters: DataFrame, measures: DataFrame, keys: Sequence[str], *,
    voxels: DataFrame, field: DataFrame, projections: DataFrame, grid: V.Grid, bouton_density: float,
) -> tuple[DataFrame, DataFrame]:
    """All properties of the clusters, and the bars of their tufts.

    To :func:`arborframe.operators.clustering.cluster_properties` come the rotated orientation,
    region, projection and mean tuft length, and the number of bars with the sums of their births
    and deaths; the bars themselves are the second table.
    """
    keys, own = list(keys), [*keys, "tuft_id"]
    base = cluster_properties(section_table, members, clusters, measures, keys)
    turned = written(rotated(base, field, grid), "tuft-properties")
    bars = written(tuft_barcodes(tuft_sections(section_table, members, turned, keys), keys), "tuft-barcodes")
    summed = bars.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum("birth").alias("sum_of_births"), F.sum("death").alias("sum_of_deaths")
    )
    full = with_projections(turned, keys, voxels, projections, grid, bouton_density=bouton_density)
    return full.join(summed, own, "left"), bars
