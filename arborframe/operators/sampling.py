"""Source and target sampling: populations, targets, tuft numbers, coordinates, barcodes.

Every draw is a function of the row's key (see :mod:`arborframe.functions.draws`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import normal, race, seed_from_name, uniform
from arborframe.operators.core import accumulate, numbered, unit_slice, weighted_pick
from arborframe.operators.spatial import close_components
from arborframe.operators.voxels import Grid, into_hemisphere, lookup, region_points

# Name of the population used when none is known; rounds of target draws.
DEFAULT_POPULATION = "default"
MAX_TRIES = 10

AXON = ("morphology", "axon_id")


def source_points(
    cells: DataFrame, grafting: DataFrame | None, section_ends: DataFrame | None,
    voxels: DataFrame | None, grid: Grid | None,
) -> DataFrame:
    """Start point of every axon in atlas coordinates, and the region of its cell.

    ``cells``: (morphology, x, y, z).  ``grafting``: (morphology, grafting_section_id, source_x,
    source_y, source_z), all but the name may be NULL; several rows make several axons.
    ``section_ends``: (morphology, section_id, x, y, z) relative to the cell.  A missing start
    is the cell itself, or the end of the grafting section when one is given.
    """
    src = geo.triple("source_")
    out = cells
    if grafting is not None:
        out = out.join(grafting, "morphology", "left")
    for c in src:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    if "grafting_section_id" not in out.columns:
        out = out.withColumn("grafting_section_id", F.lit(-1).cast("bigint"))
    out = out.withColumn("grafting_section_id", F.coalesce("grafting_section_id", F.lit(-1)))
    missing = F.lit(False)
    for c in src:
        missing = missing | F.col(c).isNull()
    out = out.withColumn("_missing", missing)
    shift = [F.lit(0.0)] * 3
    if section_ends is not None:
        ends = section_ends.select(
            "morphology", F.col("section_id").alias("grafting_section_id"),
            *[F.col(a).alias(f"_e{a}") for a in geo.AXES],
        )
        out = out.join(ends, ["morphology", "grafting_section_id"], "left")
        shift = [F.coalesce(F.col(f"_e{a}"), F.lit(0.0)) for a in geo.AXES]
    for c, a, s in zip(src, geo.AXES, shift):
        out = out.withColumn(
            c, F.col(a) + F.when(F.col("_missing"), s).otherwise(F.col(c))
        )
    out = out.drop("_missing", "_ex", "_ey", "_ez")
    if "source_brain_region_id" in out.columns:
        return out
    return lookup(out, voxels, grid, ["region_id"]).withColumnRenamed(
        "region_id", "source_brain_region_id"
    )


def combine_existing_axons(cells: DataFrame, existing: DataFrame) -> DataFrame:
    """Merge the axons already present in a morphology with the ones asked for.

    ``existing``: (morphology, axon_id, source_x, source_y, source_z).  ``cells`` rows may name
    the existing axon they rebuild in ``rebuilt_existing_axon_id``; these replace it, rows that
    name an unknown axon go, and the remaining existing axons are added.  Without that column the
    existing axons replace the rows of their morphology.
    """
    src = geo.triple("source_")
    rest = cells.drop("morphology", "grafting_section_id", *src, "rebuilt_existing_axon_id").columns
    per_cell = cells.groupBy("morphology").agg(F.min(F.struct(*rest)).alias("_cell")).select(
        "morphology", "_cell.*"
    ) if rest else cells.select("morphology").distinct()
    if "rebuilt_existing_axon_id" in cells.columns:
        known = existing.select("morphology", F.col("axon_id").alias("rebuilt_existing_axon_id"))
        asked = cells.select("morphology", "rebuilt_existing_axon_id").distinct()
        kept = cells.join(known, ["morphology", "rebuilt_existing_axon_id"], "left_semi")
        fresh = existing.withColumnRenamed("axon_id", "rebuilt_existing_axon_id").join(
            asked, ["morphology", "rebuilt_existing_axon_id"], "left_anti"
        )
    else:
        kept = cells.join(existing.select("morphology").distinct(), "morphology", "left_anti")
        fresh = existing.drop("axon_id")
    added = fresh.join(per_cell, "morphology").withColumn(
        "grafting_section_id", F.lit(-1).cast("bigint")
    )
    out = kept.unionByName(added, allowMissingColumns=True)
    return out.na.fill(0.0, subset=[c for c in src if c in out.columns])


def repeated_rebuild_ids(cells: DataFrame) -> DataFrame:
    """(morphology, rebuilt_existing_axon_id) that occur more than once; must be empty."""
    return (
        cells.groupBy("morphology", "rebuilt_existing_axon_id")
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def map_populations(
    cells: DataFrame, populations: DataFrame, elders: DataFrame, *, order: str,
    hemisphere: Column | None = None,
) -> DataFrame:
    """Cells with a population drawn among those of the deepest region around the cell.

    ``populations``: (brain_region_id, population_id, probability, order, [hemisphere]), order
    a unique integer.  ``elders`` is the ascendants closure.  Which region decides is settled
    once per region, not per cell; the draw is one per (morphology, region).
    """
    have = populations.select(F.col("brain_region_id").alias("elder_id")).distinct()
    asked = cells.select(F.col("source_brain_region_id").alias("id")).distinct()
    deepest = (
        asked.join(elders, "id").join(have, "elder_id", "left_semi")
        .groupBy(F.col("id").alias("source_brain_region_id"))
        .agg(F.max_by("elder_id", "st_level").alias("_region"))
    )
    options = populations.withColumnRenamed("brain_region_id", "_region")
    keys = ["_region"]
    # of a cell's several points in a region, the first in the order of the coordinates decides
    once = (
        cells.groupBy("morphology", "source_brain_region_id")
        .agg(F.min(F.struct(*geo.AXES)).alias("_at"))
        .select("morphology", "source_brain_region_id", "_at.*")
        .join(deepest, "source_brain_region_id")
    )
    if hemisphere is not None:
        once = once.withColumn("hemisphere", hemisphere)
        keys = ["_region", "hemisphere"]
    picked = weighted_pick(
        once, options, keys,
        draw=uniform("morphology", "source_brain_region_id", F.lit("population")),
        weight="probability", order=order, payload=["population_id"],
    ).select("morphology", "source_brain_region_id", "population_id")
    return cells.join(picked, ["morphology", "source_brain_region_id"], "left").withColumn(
        "population_id", F.coalesce("population_id", F.lit(DEFAULT_POPULATION))
    )


def axon_ids(sources: DataFrame, *, order: str) -> DataFrame:
    """Axon ids by order inside a cell, from 0."""
    return numbered(sources, ["morphology"], order, "axon_id")


def candidate_targets(sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every target the population of an axon projects to, and the axons without any.

    With a column ``st_level`` only rows of the deepest level per cell and region stay.
    """
    options = targets.withColumnsRenamed(
        {"source_population_id": "population_id", "probability": "target_probability"}
    )
    found = sources.join(options, "population_id").filter(F.col("target_probability").isNotNull())
    missing = sources.join(
        options.filter(F.col("target_probability").isNotNull()).select("population_id").distinct(),
        "population_id", "left_anti",
    ).select(*AXON)
    if "st_level" in sources.columns:
        group = ["morphology", "source_brain_region_id"]
        deepest = found.groupBy(*group).agg(F.max("st_level").alias("st_level"))
        found = found.join(deepest, [*group, "st_level"])
    return found, missing


def pick_targets(
    candidates: DataFrame, *, request: Sequence[str], tries: int = MAX_TRIES
) -> tuple[DataFrame, DataFrame]:
    """Bernoulli selection; an axon without any hit is drawn again, at most ``tries`` rounds.

    A row's first hit is found in place, without drawing beyond it; the axon's round is the
    first in which any of its rows hits, and the rows that hit in it are selected.  Returns the
    selected rows and the axons that never hit.
    """
    first = F.coalesce(
        *[
            F.when(uniform(*request, F.lit(f"try{t}")) <= F.col("target_probability"), F.lit(t))
            for t in range(tries)
        ]
    )
    rows = candidates.withColumn("_hit", first)
    rounds = rows.groupBy(*AXON).agg(F.min("_hit").alias("_round"))
    axon = Window.partitionBy(*AXON)  # the targets of one axon
    selected = rows.filter(F.col("_hit").isNotNull()).withColumn("_round", F.min("_hit").over(axon)).filter(
        F.col("_hit") == F.col("_round")).drop("_hit", "_round")
    return selected, rounds.filter(F.col("_round").isNull()).select(*AXON)


def tuft_numbers(selected: DataFrame, numbers: DataFrame, *, request: Sequence[str]) -> DataFrame:
    """Rows repeated once per tuft, with ``tuft_num`` from 0.

    ``numbers``: (target_population_id, mean_tuft_number, std_tuft_number).  The count is the
    whole part of a normal draw, at least 1, and 1 for unknown populations.
    """
    drawn = normal(
        uniform(*request, F.lit("tuft1")), uniform(*request, F.lit("tuft2")),
        F.col("mean_tuft_number"), F.col("std_tuft_number"),
    )
    count = F.greatest(F.lit(1), F.coalesce(drawn.cast("bigint"), F.lit(1)))
    return (
        selected.join(numbers, "target_population_id", "left")
        .withColumn("num_tufts_to_grow", count)
        .withColumn("tuft_num", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_tufts_to_grow") - 1)))
        .drop("mean_tuft_number", "std_tuft_number")
    )


def target_coordinates(
    rows: DataFrame, mask: DataFrame, grid: Grid, *, request: Sequence[str],
    side: str | None = None,
) -> DataFrame:
    """A random position in the target region per row; NULL where the region has no voxel.

    ``mask``: (target_brain_region_id, i, j, k).  With ``side`` the position is mirrored into
    that hemisphere.
    """
    asks = rows.select("target_brain_region_id", F.struct(*rows.columns).alias("_row"))
    # an expression, so that the rows do not carry their key a second time
    key = F.concat_ws("|", *[F.col("_row")[c].cast("string") for c in request])
    found = region_points(mask, asks, grid, region="target_brain_region_id", request=key, how="left")
    out = found.select("_row.*", *[F.col(a).alias(f"target_{a}") for a in geo.AXES])
    if side is not None:
        out = out.withColumn("target_z", into_hemisphere(F.col("target_z"), F.col(side), grid))
    return out


def terminal_ids(rows: DataFrame, order: Sequence[str], *, slice_by: Column) -> DataFrame:
    """Terminal ids per axon along the order, from 1."""
    return accumulate(rows, AXON, list(order), slice_by=slice_by, number="terminal_id")


def merge_close_targets(targets: DataFrame, precision: float | None) -> DataFrame:
    """Targets of an axon that hang together within the precision share the smallest id.

    A target without a position keeps its own id.
    """
    if precision is None:
        return targets
    placed = F.lit(True)
    for c in (*AXON, "terminal_id", *geo.triple("target_")):
        placed = placed & F.col(c).isNotNull()
    rest = [c for c in targets.columns if c not in (*AXON, "terminal_id")]
    pts = targets.filter(placed).select(
        *AXON, "terminal_id", F.struct(*rest).alias("_row"), *[F.col(f"target_{a}").alias(a) for a in geo.AXES]
    )
    merged = close_components(pts, AXON, precision, node="terminal_id", carry=["_row"]).select(
        *AXON, F.col("component").alias("terminal_id"), "_row.*"
    )
    return merged.unionByName(targets.filter(~placed))


def unique_terminals(targets: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (axon, terminal): the first along the order."""
    rest = [c for c in targets.columns if c not in (*AXON, "terminal_id")]
    return targets.groupBy(*AXON, "terminal_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*AXON, "terminal_id", "_row.*")


def failed_axons(targets: DataFrame) -> DataFrame:
    """Axons none of whose rows has a target population."""
    return (
        targets.groupBy(*AXON)
        .agg(F.bool_and(F.col("target_population_id").isNull()).alias("_none"))
        .filter("_none").select(*AXON)
    )


def random_seeds(cells: DataFrame) -> DataFrame:
    """A permutation of 0..n-1 over the distinct morphologies, as ``seed``."""
    names = cells.select("morphology").distinct().withColumn("_u", uniform("morphology", F.lit("seed")))
    out = accumulate(names, [], ["_u", "morphology"], slice_by=unit_slice(F.col("_u"), 4096), number="seed")
    return out.select("morphology", (F.col("seed") - 1).alias("seed"))


def named_seeds(cells: DataFrame) -> DataFrame:
    """A seed per morphology that depends on its name only."""
    return cells.select("morphology", seed_from_name("morphology").alias("seed")).distinct()


def weighted_choice(
    rows: DataFrame, keys: Sequence[str], *, weight: str, request: Sequence[str]
) -> DataFrame:
    """One row per group with odds by weight; partial aggregation, no ordering of a group."""
    rest = [c for c in rows.columns if c not in keys]
    time = race(uniform(*request), F.col(weight))
    return (
        rows.withColumn("_time", time).filter(F.col("_time").isNotNull())
        .groupBy(*keys).agg(F.min_by(F.struct(*rest), "_time").alias("_row"))
        .select(*keys, "_row.*")
    )


def pick_barcodes(
    terminals: DataFrame, edges: DataFrame, tufts: DataFrame, *, order: str = "tuft_order",
) -> DataFrame:
    """A tuft (weight, orientation, barcode) for every terminal, drawn by weight.

    ``terminals``: (keys, terminal_id, target_population_id, ...); ``edges``: (keys,
    source_terminal_id, target_terminal_id, source_is_terminal, target_is_terminal, section_id,
    reversed_edge); ``tufts``: (population_id, weight, order, payload...).  A terminal takes part
    once per edge it ends; populations without any tuft use the default one, by key and without
    pairing everything with everything.  ``use_parent`` tells that the tuft grows from the start
    of its section.
    """
    keys = list(AXON)
    common = [*keys, "section_id", "reversed_edge"]
    as_source = edges.filter("source_is_terminal").select(
        *common, F.col("source_terminal_id").alias("terminal_id"),
        F.lit(True).alias("source_is_terminal"), F.lit(False).alias("target_is_terminal"),
    )
    as_target = edges.filter("target_is_terminal").select(
        *common, F.col("target_terminal_id").alias("terminal_id"),
        F.lit(False).alias("source_is_terminal"), F.lit(True).alias("target_is_terminal"),
    )
    ends = terminals.join(as_source.unionByName(as_target), [*keys, "terminal_id"])
    ends = ends.withColumn(
        "use_parent",
        (F.col("source_is_terminal") & ~F.col("reversed_edge"))
        | (F.col("target_is_terminal") & F.col("reversed_edge")),
    )
    # the edge is drawn first (equal odds: every edge brings the same tufts), then the tuft
    one_edge = ends.groupBy(*keys, "terminal_id", "target_population_id").agg(
        F.min_by(
            F.struct(*[c for c in ends.columns if c not in (*keys, "terminal_id", "target_population_id")]),
            F.struct(uniform(*keys, "terminal_id", "section_id", F.lit("edge")), "section_id"),
        ).alias("_row")
    ).select(*keys, "terminal_id", "target_population_id", "_row.*")
    known = tufts.select(F.col("population_id").alias("target_population_id"), F.lit(True).alias("_known")).distinct()
    asked = one_edge.join(known, "target_population_id", "left").withColumn(
        "population_id",
        F.when(F.col("_known"), F.col("target_population_id")).otherwise(F.lit(DEFAULT_POPULATION)),
    ).drop("_known")
    weighted = tufts.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    payload = [c for c in tufts.columns if c not in ("population_id", "weight", order)]
    return weighted_pick(
        asked, weighted, ["population_id"],
        draw=uniform(*keys, "terminal_id", "target_population_id", F.lit("barcode")),
        weight="weight", order=order, payload=[*payload],
    )


def tuft_directions(picked: DataFrame) -> DataFrame:
    """Direction of each tuft: target rotation times tuft orientation, as ``dir_x .. dir_z``."""
    v = [F.col("tuft_orientation")[n] for n in range(3)]
    turned = geo.rotate(F.col("target_orientation"), v)
    return picked.select("*", *[c.alias(f"dir_{a}") for c, a in zip(turned, geo.AXES)])


def random_cells(
    mask: DataFrame, voxels: DataFrame, regions: DataFrame, grid: Grid, requests: DataFrame,
    *, count: int, prefix: str = "",
) -> DataFrame:
    """Random cells: zero-padded names, positions, identity orientation, region acronym.

    ``requests`` numbers the wanted cells from 1 (column ``n``), ``count`` is how many there are.
    ``mask`` lists the allowed voxels (i, j, k).
    """
    width = len(str(count))
    one = mask.select("i", "j", "k").withColumn("_mask", F.lit(1))
    asks = requests.select("n", F.lit(1).alias("_mask"))
    pts = region_points(one, asks, grid, region="_mask", request="n").select("n", *geo.AXES)
    found = lookup(pts, voxels, grid, ["region_id"])
    names = regions.select(F.col("id").alias("region_id"), F.col("acronym").alias("region"))
    return found.join(names, "region_id", "left").select(
        F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), width, "0")).alias("morphology"),
        *geo.AXES, geo.identity_matrix().alias("orientation"),
        F.col("region_id").alias("atlas_id"), "region",
    )
