"""Region hierarchies: levels, closures, lookups by name, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.operators.trees import ancestors, fold


def top_regions(regions: DataFrame) -> DataFrame:
    """Regions whose parent is not in the table."""
    ids = regions.select(F.col("id").alias("parent_id"))
    return regions.join(ids, "parent_id", "left_anti").select(*regions.columns)


def _rooted(regions: DataFrame) -> DataFrame:
    """(id, up): parent id, NULL where the parent is not in the table."""
    ids = regions.select(F.col("id").alias("parent_id"), F.col("id").alias("up"))
    return regions.select("id", "parent_id").join(ids, "parent_id", "left").select("id", "up")


def with_level(regions: DataFrame) -> DataFrame:
    """Adds ``st_level``, 0 for rows whose parent is not in the table."""
    depth = fold(_rooted(regions), [], node="id", parent="up", up={"_n": F.lit(1)})
    return regions.join(
        depth.select("id", (F.col("_n") - 1).cast("int").alias("st_level")), "id"
    ).select(*regions.columns, "st_level")


def descendants(regions: DataFrame) -> DataFrame:
    """(id, youth_id, st_level): every region with itself and all below; level of the youth."""
    pairs = ancestors(_rooted(regions), [], node="id", parent="up")
    level = pairs.groupBy("id").agg(F.max("steps").cast("int").alias("st_level"))
    return pairs.join(level, "id").select(
        F.col("ancestor").alias("id"), F.col("id").alias("youth_id"), "st_level"
    )


def ascendants(regions: DataFrame) -> DataFrame:
    """(id, elder_id, st_level): every region with itself and all above; level of the elder."""
    pairs = ancestors(_rooted(regions), [], node="id", parent="up")
    level = pairs.groupBy(F.col("id").alias("ancestor")).agg(
        F.max("steps").cast("int").alias("st_level")
    )
    return pairs.join(level, "ancestor").select(
        "id", F.col("ancestor").alias("elder_id"), "st_level"
    )


def resolve(
    asked: DataFrame, regions: DataFrame, closure: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ids of regions asked for by id, numeric text, name or acronym; and what was not found.

    ``asked`` has one string column ``key``.  Text that reads as a whole number is matched as
    an id only.  With the :func:`descendants` closure every region below is included.
    """
    keys = asked.select("key").distinct().withColumn("_id", F.expr("try_cast(trim(key) as bigint)"))
    numeric = keys.filter(F.col("_id").isNotNull())
    text = keys.filter(F.col("_id").isNull())
    hits = (
        numeric.join(regions.select(F.col("id").alias("_id")), "_id").select("key", F.col("_id").alias("id"))
        .unionByName(text.join(regions.select("id", F.col("name").alias("key")), "key").select("key", "id"))
        .unionByName(text.join(regions.select("id", F.col("acronym").alias("key")), "key").select("key", "id"))
    )
    missing = asked.select("key").distinct().join(hits, "key", "left_anti")
    if closure is not None:
        found = hits.join(closure, "id").select(F.col("youth_id").alias("id"))
    else:
        found = hits.select("id")
    return found.distinct(), missing


def voxels_in(
    voxels: DataFrame, ids: DataFrame, missing: DataFrame | None = None, *, inverse: bool = False
) -> DataFrame:
    """Voxels whose region is one of ``ids``; unresolved numeric keys count as raw values."""
    wanted = ids.select(F.col("id").alias("region_id"))
    if missing is not None:
        raw = missing.select(F.expr("try_cast(trim(key) as bigint)").alias("region_id"))
        wanted = wanted.unionByName(raw.filter(F.col("region_id").isNotNull()))
    return voxels.join(wanted.distinct(), "region_id", "left_anti" if inverse else "left_semi")


def masks(voxels: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxels of each region with everything below it, and the regions that have none.

    The mask table repeats a voxel once per region above it, not per pair of regions.
    """
    pairs = closure.select(F.col("id").alias("mask_id"), F.col("youth_id").alias("region_id"))
    mask = voxels.join(pairs, "region_id").select("mask_id", "i", "j", "k")
    used = voxels.select("region_id").distinct()
    filled = pairs.join(used, "region_id", "left_semi").select("mask_id").distinct()
    empty = closure.select(F.col("id").alias("mask_id")).distinct().join(
        filled, "mask_id", "left_anti"
    )
    return mask, empty


def volumes(voxels: DataFrame, closure: DataFrame, voxel_volume: float) -> DataFrame:
    """Voxel count and volume of every region with everything below it; 0 where empty.

    Voxels are counted per own region first, so the closure meets a table with one row per
    region, whatever the size of the grid.
    """
    own = voxels.groupBy(F.col("region_id").alias("youth_id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        closure.join(own, "youth_id", "left")
        .groupBy("id")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("nb_voxels"))
        .withColumn("volume", F.col("nb_voxels") * F.lit(float(voxel_volume)))
    )


def first_nested(asked: DataFrame, known: DataFrame, elders: DataFrame) -> DataFrame:
    """First region of the known set on the way up from ``id`` (itself first), else ``id``.

    Ids of 0 or less stay as they are.  ``elders`` is :func:`ascendants`.
    """
    ids = asked.select("id").distinct()
    best = (
        ids.filter("id > 0")
        .join(elders, "id")
        .join(known.select(F.col("id").alias("elder_id")).distinct(), "elder_id", "left_semi")
        .groupBy("id")
        .agg(F.max_by("elder_id", "st_level").alias("_elder"))
    )
    return asked.join(best, "id", "left").withColumn(
        "nested_id", F.coalesce("_elder", "id")
    ).drop("_elder")


def parent_acronyms(regions: DataFrame) -> DataFrame:
    """Regions with the acronym of their parent, NULL at the top."""
    up = regions.select(F.col("id").alias("parent_id"), F.col("acronym").alias("acronym_parent"))
    return regions.join(up, "parent_id", "left")


def child_acronyms(regions: DataFrame) -> DataFrame:
    """One row per (parent acronym, child acronym, child id): the children of each region."""
    return parent_acronyms(regions).filter(F.col("acronym_parent").isNotNull()).select(
        F.col("acronym_parent").alias("region_acronym"),
        F.col("acronym").alias("subregion_acronym"),
        F.col("id").alias("subregion_id"),
    )
