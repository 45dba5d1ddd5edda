"""Connectivity recipes: flatten nested entries into tables and derive probabilities.

The entry tables are those of :func:`arborframe.sources.documents.read_recipe`:
populations (name, atlas_region array<struct<name, subregions>>, ...), projections (source,
targets array<struct>), layer_profiles (name, relative_densities) and p_types (population,
fractions map, interaction_mat).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns that separate the number of a subregion or layer from its prefix.
SUBREGION_PATTERN = r"(\d+.*)"
LAYER_PATTERN = r"l(.*)"
MIN_NEURONS = 2


def flatten_populations(entries: DataFrame) -> DataFrame:
    """One row per population, atlas region and subregion (NULL without subregions)."""
    return (
        entries.withColumnRenamed("name", "pop_raw_name")
        .withColumn("_region", F.explode_outer("atlas_region"))
        .withColumn("region_acronym", F.col("_region.name"))
        .withColumn("sub_region", F.explode_outer("_region.subregions"))
        .drop("_region", "atlas_region")
    )


def name_subregions(
    populations: DataFrame, *, separator: str = ";", uppercase: bool = False,
    remove_prefix: bool = False,
) -> DataFrame:
    """Adds ``formatted_subregion`` and ``subregion_acronym``; NULL parts give NULL."""
    text = F.col("sub_region")
    if uppercase:
        text = F.upper(text)
    if remove_prefix:
        found = F.regexp_extract(text, SUBREGION_PATTERN, 1)
        text = F.when(found != "", found)
    return populations.withColumn("formatted_subregion", text).withColumn(
        "subregion_acronym",
        F.concat(F.col("region_acronym"), F.lit(separator), F.col("formatted_subregion")),
    )


def region_ids(
    populations: DataFrame, regions: DataFrame, *, first: str = "subregion_acronym",
    second: str | None = "region_acronym", into: str = "atlas_region_id",
) -> tuple[DataFrame, DataFrame]:
    """Region id by acronym with a fallback column, and the rows with none or several.

    Problems are (first, second, n_ids) rows; callers that want the strict behaviour stop when
    there are any.
    """
    by_name = regions.groupBy("acronym").agg(
        F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    one = by_name.select(F.col("acronym").alias(first), F.col("_id").alias("_id1"), F.col("_n").alias("_n1"))
    out = populations.join(one, first, "left")
    if second is not None:
        two = by_name.select(F.col("acronym").alias(second), F.col("_id").alias("_id2"), F.col("_n").alias("_n2"))
        out = out.join(two, second, "left")
    else:
        out = out.withColumn("_id2", F.lit(None).cast("bigint")).withColumn("_n2", F.lit(None).cast("bigint"))
    out = out.withColumn(into, F.coalesce("_id1", "_id2")).withColumn(
        "_hits", F.coalesce("_n1", "_n2", F.lit(0))
    )
    bad = out.filter(F.col("_hits") != 1).select(
        F.col(first).alias("first_name"),
        (F.col(second) if second else F.lit(None).cast("string")).alias("second_name"),
        F.col("_hits").alias("n_ids"),
    ).distinct()
    return out.drop("_id1", "_n1", "_id2", "_n2", "_hits"), bad


def volume_fractions(populations: DataFrame, volumes: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds the region's volume and the share of its parent region's volume, within [0, 1].

    ``volumes`` is (id, nb_voxels, volume).  A missing or undefined share counts as 1.
    """
    own = volumes.select(F.col("id").alias("atlas_region_id"), "nb_voxels", F.col("volume").alias("atlas_region_volume"))
    whole = regions.select(F.col("acronym").alias("region_acronym"), "id").join(volumes, "id").groupBy(
        "region_acronym"
    ).agg(F.max("volume").alias("_total"))
    share = F.try_divide(F.col("atlas_region_volume"), F.col("_total"))
    grown = F.when((F.col("_total") == 0) & (F.col("atlas_region_volume") > 0), F.lit(1.0)).otherwise(share)
    return (
        populations.join(own, "atlas_region_id", "left")
        .join(whole, "region_acronym", "left")
        .withColumn(
            "sub_region_volume_frac",
            F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), grown)), F.lit(1.0)),
        )
        .drop("_total")
    )


def flatten_layer_profiles(entries: DataFrame) -> DataFrame:
    """(name, layer_profile_num, layer_index, layer, formatted_layer, value), one per layer."""
    layer = F.col("layer")
    found = F.regexp_extract(layer, LAYER_PATTERN, 1)
    return (
        entries.select("name", F.posexplode("relative_densities").alias("layer_profile_num", "_d"))
        .select(
            "name", "layer_profile_num", F.col("_d.value").alias("value"),
            F.posexplode("_d.layers").alias("layer_index", "layer"),
        )
        .withColumn("formatted_layer", F.when(layer.rlike(LAYER_PATTERN), found).otherwise(layer))
    )


def duplicated_sources(projections: DataFrame) -> DataFrame:
    """Sources that occur in more than one projection entry; must be empty."""
    return projections.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def flatten_projections(projections: DataFrame, populations: DataFrame) -> DataFrame:
    """One row per source population row and target: target fields become columns.

    ``target_layer_profile_name`` is that of the first profile, NULL for a target without any;
    ``target_layer_profiles`` has all of them.
    """
    targets = projections.select("source", F.posexplode("targets").alias("target_num", "_t")).select(
        "source", "target_num",
        F.col("_t.population").alias("target_population_name"),
        F.col("_t.projection_name").alias("target_projection_name"),
        F.col("_t.density").alias("target_density"),
        F.col("_t.hemisphere").alias("target_hemisphere"),
        F.col("_t.presynaptic_mapping").alias("topographical_mapping"),
        F.col("_t.target_layer_profiles").alias("target_layer_profiles"),
        F.get("_t.target_layer_profiles", F.lit(0))["name"].alias("target_layer_profile_name"),
        F.col("_t.synapse_types").alias("target_synapse_types"),
    )
    source = populations.withColumn("source", F.col("pop_raw_name"))
    return targets.join(source, "source", "left")


def target_regions(
    targets: DataFrame, populations: DataFrame, regions: DataFrame
) -> DataFrame:
    """Region and subregions of every target, restricted to subregions the populations name.

    The region is that of the target population, or the target's name itself.
    """
    of_pop = populations.select(
        F.col("pop_raw_name").alias("target_population_name"),
        F.col("region_acronym").alias("_pop_region"),
    ).distinct()
    placed = targets.join(of_pop, "target_population_name", "left").withColumn(
        "target_region", F.coalesce("_pop_region", "target_population_name")
    ).drop("_pop_region")
    ids = regions.select(F.col("acronym").alias("target_region"), F.col("id").alias("target_region_atlas_id"))
    tops = regions.select(F.col("id").alias("parent_id"), F.col("acronym").alias("target_region"))
    kids = regions.select("id", "parent_id", "acronym").join(tops, "parent_id").select(
        "target_region", F.col("acronym").alias("target_subregion_acronym"),
        F.col("id").alias("target_subregion_atlas_id"),
    )
    named = populations.select(F.col("subregion_acronym").alias("target_subregion_acronym")).distinct()
    return (
        placed.join(ids, "target_region", "left")
        .join(kids, "target_region", "left")
        .join(named, "target_subregion_acronym", "left_semi")
    )


def layer_probabilities(
    targets: DataFrame, populations: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Share of each target subregion in its region, from layer densities and volumes.

    The share is normalised over (source, source sub_region, projection, target region); rows
    with a NULL among these form no group and keep their value.
    """
    sub = populations.select(
        F.col("subregion_acronym").alias("target_subregion_acronym"),
        F.col("sub_region").alias("sub_region_target"),
        F.col("formatted_subregion").alias("formatted_subregion_target"),
        F.col("sub_region_volume_frac").alias("sub_region_volume_frac_target"),
    ).distinct()
    density = profiles.select(
        F.col("name").alias("target_layer_profile_name"),
        F.col("layer").alias("sub_region_target"),
        F.col("value").alias("target_layer_profile_density"),
    )
    out = (
        targets.join(sub, "target_subregion_acronym", "left")
        .join(density, ["target_layer_profile_name", "sub_region_target"], "left")
        .withColumn("target_layer_profile_density", F.coalesce("target_layer_profile_density", F.lit(1.0)))
        .withColumn(
            "target_layer_profile_prob",
            F.col("target_layer_profile_density") * F.col("sub_region_volume_frac_target"),
        )
    )
    group = ["source", "sub_region", "target_projection_name", "target_region"]
    norm = out.na.drop(subset=group).groupBy(*group).agg(
        F.sum("target_layer_profile_prob").alias("target_layer_profile_norm_factor")
    )
    ratio = F.try_divide(F.col("target_layer_profile_prob"), F.col("target_layer_profile_norm_factor"))
    return (
        out.join(norm, group, "left")
        .withColumn("target_layer_profile_norm_factor", F.coalesce("target_layer_profile_norm_factor", F.lit(1.0)))
        .withColumn("target_layer_profile_region_prob", F.coalesce(ratio, F.lit(1.0)))
        .withColumn("target_atlas_id", F.coalesce("target_subregion_atlas_id", "target_region_atlas_id"))
    )


def flatten_fractions(p_types: DataFrame) -> DataFrame:
    """(pop_raw_name, target_projection_name, target_projection_strength)."""
    return p_types.select(
        F.col("population").alias("pop_raw_name"),
        F.explode("fractions").alias("target_projection_name", "target_projection_strength"),
    )


def interaction_strengths(p_types: DataFrame) -> DataFrame:
    """Symmetric matrix per population as rows (population, row_proj, col_proj, strength).

    ``strengths`` lists the upper triangle row by row; the diagonal is 1.  With n names, entry
    (r, c) with r < c sits at r*n - r*(r+1)/2 + (c - r - 1).
    """
    base = p_types.filter(F.col("interaction_mat").isNotNull()).select(
        "population", F.col("interaction_mat.projections").alias("_p"),
        F.col("interaction_mat.strengths").alias("_s"),
    )
    n = F.size("_p")
    rows = base.select("*", F.posexplode("_p").alias("_r", "row_proj"))
    cells = rows.select("*", F.posexplode("_p").alias("_c", "col_proj"))
    lo, hi = F.least("_r", "_c"), F.greatest("_r", "_c")
    place = (lo * n - F.floor(lo * (lo + 1) / 2) + (hi - lo - 1)).cast("int")
    return cells.select(
        "population", "row_proj", "col_proj",
        F.when(F.col("_r") == F.col("_c"), F.lit(1.0)).otherwise(F.get("_s", place)).alias("strength"),
    )


def projection_probabilities(targets: DataFrame, fractions: DataFrame, regions: DataFrame) -> DataFrame:
    """Probability of each projection into each target region; only positive ones, distinct."""
    usable = targets.filter(F.col("target_region_atlas_id").isNotNull())
    ids = regions.select(F.col("acronym").alias("_acronym"), F.col("id").alias("target_brain_region_id"))
    return (
        usable.join(fractions, ["pop_raw_name", "target_projection_name"], "left")
        .withColumn(
            "probability",
            F.col("target_projection_strength") * F.col("target_layer_profile_region_prob"),
        )
        .filter(F.col("probability") > 0)
        .withColumn("_acronym", F.coalesce("target_subregion_acronym", "target_region"))
        .join(ids, "_acronym")
        .select(
            F.col("atlas_region_id").alias("source_brain_region_id"),
            F.col("pop_raw_name").alias("source_population_id"),
            "target_brain_region_id",
            F.col("target_projection_name").alias("target_population_id"),
            "probability",
        )
        .distinct()
    )


def population_probabilities(pairs: DataFrame) -> DataFrame:
    """1 / number of populations of a region, from (brain_region_id, population_id) rows."""
    once = pairs.select("brain_region_id", "population_id").distinct()
    counts = once.groupBy("brain_region_id").agg(
        (F.lit(1.0) / F.count(F.lit(1))).alias("probability")
    )
    return once.join(counts, "brain_region_id")


def neuron_numbers(populations: DataFrame, density: float) -> DataFrame:
    """Number of neurons per population row: whole part of volume times density, at least 2."""
    count = (F.col("atlas_region_volume") * F.lit(float(density))).cast("bigint")
    return populations.select(
        "pop_raw_name", "atlas_region_id", "atlas_region_volume",
        F.greatest(count, F.lit(MIN_NEURONS).cast("bigint")).alias("pop_neuron_numbers"),
    )


def projection_numbers(targets: DataFrame, numbers: DataFrame) -> DataFrame:
    """Targets with the volume and neuron number of their target population."""
    known = numbers.select(
        F.col("pop_raw_name").alias("target_population_name"),
        F.col("atlas_region_volume").alias("atlas_region_volume_target"), "pop_neuron_numbers",
    ).distinct()
    return targets.join(known, "target_population_name", "left")


def one_to_one_probabilities(
    cells: DataFrame, tufts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A population per axon and a target per tuft, all with probability 1.

    ``cells`` is (morphology, ...), ``tufts`` (morphology, axon_id, tuft_id,
    common_ancestor_x, common_ancestor_y, common_ancestor_z).
    """
    own = F.concat_ws("_", F.col("morphology"), F.col("axon_id").cast("string"))
    named = tufts.withColumn("population_id", own)
    populations = named.select(
        "population_id", F.col("population_id").alias("brain_region_id"),
        F.lit(1.0).alias("probability"),
    ).distinct()
    target = F.concat_ws("-", "population_id", F.col("tuft_id").cast("string"))
    projections = (
        cells.select("morphology").join(named, "morphology", "left")
        .filter(F.col("tuft_id").isNotNull())
        .select(
            "morphology", "axon_id", "tuft_id",
            F.col("population_id").alias("source_population_id"),
            F.col("population_id").alias("source_brain_region_id"),
            target.alias("target_population_id"), target.alias("target_brain_region_id"),
            *[F.col(f"common_ancestor_{a}").alias(f"target_{a}") for a in "xyz"],
            F.lit(1.0).alias("probability"),
        )
    )
    return populations, projections


def attach_source_regions(
    cells: DataFrame, projections: DataFrame, *, order: Sequence[str] = ("axon_id", "tuft_id")
) -> tuple[DataFrame, DataFrame]:
    """Cells with the source region of their first projection row, and the cells without one."""
    first = projections.groupBy("morphology").agg(
        F.min_by("source_brain_region_id", F.struct(*order)).alias("source_brain_region_id")
    )
    joined = cells.join(first, "morphology", "left")
    return (
        joined.filter(F.col("source_brain_region_id").isNotNull()),
        joined.filter(F.col("source_brain_region_id").isNull()).select("morphology"),
    )
