"""Points, segments and polylines against a regular voxel grid.

A grid is described by a :class:`Grid`; voxel values live in sparse tables keyed by the
integer columns ``i, j, k``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators.core import accumulate, id_slice, numbered, written
from arborframe.operators.trees import bounding_box

IJK = ("i", "j", "k")


@dataclass(frozen=True)
class Grid:
    """Voxel size, position of the lower corner and number of voxels per axis."""

    dim: tuple[float, float, float]
    offset: tuple[float, float, float]
    shape: tuple[int, int, int]

    @property
    def voxel_volume(self) -> float:
        return abs(self.dim[0] * self.dim[1] * self.dim[2])

    def frontier(self, axis: int) -> float:
        """Half the extent along an axis; the offset is not added."""
        return self.shape[axis] * self.dim[axis] * 0.5


def indices(coords: Sequence[str | Column], grid: Grid, names: Sequence[str] = IJK) -> list[Column]:
    """Voxel index columns of a position."""
    return [
        F.floor((c - F.lit(grid.offset[a])) / F.lit(grid.dim[a])).cast("int").alias(names[a])
        for a, c in enumerate(geo.cols(coords))
    ]


def centres(grid: Grid, names: Sequence[str] = IJK) -> list[Column]:
    """Centre position columns ``x, y, z`` of voxel indices."""
    return [
        ((F.col(names[a]) + F.lit(0.5)) * F.lit(grid.dim[a]) + F.lit(grid.offset[a])).alias(axis)
        for a, axis in enumerate(geo.AXES)
    ]


def lookup(
    points: DataFrame, voxels: DataFrame, grid: Grid, values: Sequence[str],
    *, coords: Sequence[str] = geo.AXES,
) -> DataFrame:
    """Points with the values of their voxel, NULL where the grid has none."""
    names = ["_i", "_j", "_k"]
    placed = points.select("*", *indices(coords, grid, names))
    v = voxels.select(*[F.col(n).alias(f"_{n}") for n in IJK], *values)
    return placed.join(v, names, "left").drop(*names)


def layers(points: DataFrame, voxels: DataFrame, region_layers: DataFrame, grid: Grid) -> DataFrame:
    """Points with the layer of their region (region_id, layer); 0 outside any layer."""
    found = lookup(points, voxels, grid, ["region_id"]).join(region_layers, "region_id", "left")
    return found.withColumn("layer", F.coalesce("layer", F.lit(0)))


def orientations(points: DataFrame, field: DataFrame, grid: Grid, *, coords=geo.AXES) -> DataFrame:
    """Points with the 3x3 ``rotation`` of their voxel; identity where missing or not a number."""
    found = lookup(points, field, grid, ["rotation"], coords=coords)
    broken = F.exists(F.flatten("rotation"), lambda v: v.isNull() | F.isnan(v))
    usable = F.col("rotation").isNotNull() & ~broken
    return found.withColumn(
        "rotation", F.when(usable, F.col("rotation")).otherwise(geo.identity_matrix())
    )


def drop_forbidden(points: DataFrame, voxels: DataFrame, forbidden: DataFrame, grid: Grid) -> DataFrame:
    """Points that do not lie in a voxel of a forbidden region (region_id)."""
    cells = voxels.join(forbidden.select("region_id"), "region_id", "left_semi").select(
        *[F.col(n).alias(f"_{n}") for n in IJK]
    )
    placed = points.select("*", *indices(geo.AXES, grid, ["_i", "_j", "_k"]))
    return placed.join(cells, ["_i", "_j", "_k"], "left_anti").drop("_i", "_j", "_k")


def hemisphere(coord: Column, grid: Grid, *, axis: int = 2, origin: str = "L") -> Column:
    """Side of a coordinate along an axis: ``origin`` below half the extent of the grid."""
    other = "R" if origin == "L" else "L"
    return F.when(coord < F.lit(grid.frontier(axis)), F.lit(origin)).otherwise(F.lit(other))


def into_hemisphere(
    coord: Column, side: Column, grid: Grid, *, axis: int = 2, origin: str = "L"
) -> Column:
    """Mirror a coordinate when it lies in the hemisphere opposite to ``side``."""
    now = hemisphere(coord, grid, axis=axis, origin=origin)
    swap = side.isin("L", "R") & (now != side)
    return F.when(swap, F.lit(2.0 * grid.frontier(axis)) - coord).otherwise(coord)


def depth(heights: DataFrame) -> DataFrame:
    """Depth field (i, j, k, depth) from the surface height ``pia`` minus the own ``y``."""
    return heights.select(*IJK, (F.col("pia") - F.col("y")).alias("depth"))


def region_points(
    mask: DataFrame, requests: DataFrame, grid: Grid, *, region: str, request: str | Column,
    random_shift: bool = True, how: str = "inner",
) -> DataFrame:
    """One random voxel of its region per request, with replacement, as a position.

    ``mask`` is (region, i, j, k) and ``requests`` (region, request, ...).  Voxels are numbered
    per region, so a request joins exactly one voxel row.  ``request`` is the key of the draws, a
    column or an expression of the requests' columns.  Requests of a region without voxels go,
    or stay without a position with ``how`` left.
    """
    order = (F.col("i") * F.lit(grid.shape[1]) + F.col("j")) * F.lit(grid.shape[2]) + F.col("k")
    flat = mask.withColumn("_flat", order.cast("bigint"))
    rows = numbered(flat, [region], "_flat", "_rn").drop("_flat")
    # one row a region; written, the planner knows how few they are and leaves the requests in place
    sizes = written(mask.groupBy(region).agg(F.count(F.lit(1)).alias("_n")), "region-sizes")
    drawn = requests.join(sizes, region, how).withColumn(
        "_rn", F.floor(uniform(request, F.lit("voxel")) * F.col("_n"))
    )
    out = drawn.join(rows, [region, "_rn"], how).select("*", *centres(grid))
    if random_shift:
        for a, axis in enumerate(geo.AXES):
            shift = (uniform(request, F.lit(f"shift_{axis}")) - F.lit(0.5)) * F.lit(grid.dim[a])
            out = out.withColumn(axis, F.col(axis) + shift)
    return out.drop("_rn", "_n")


# --- segments -----------------------------------------------------------------------------


def _crossing(a: Column, b: Column, dim: Column, offset: Column):
    """Function from a plane number to the segment parameter where it is crossed."""
    return lambda plane: (offset + plane * dim - a) / (b - a)


def voxel_pieces(
    segments: DataFrame,
    *,
    dim: Sequence[Column],
    offset: Sequence[Column],
    start: Sequence[str] = ("x_from", "y_from", "z_from"),
    end: Sequence[str] = ("x_to", "y_to", "z_to"),
) -> DataFrame:
    """Split each segment at the voxel borders it crosses.

    Adds ``piece`` (from 0), ``i, j, k``, ``piece_length`` and the piece's ends ``px0 .. pz1``.
    The parameters of all crossed planes are computed and sorted inside the row; a piece lies in
    the voxel of its midpoint, so the pieces' lengths always add up to the segment's length.
    """
    a, b = geo.cols(start), geo.cols(end)
    cuts = []
    for axis in range(3):
        lo = F.floor((F.least(a[axis], b[axis]) - offset[axis]) / dim[axis])
        hi = F.floor((F.greatest(a[axis], b[axis]) - offset[axis]) / dim[axis])
        planes = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(
            F.array().cast("array<bigint>")
        )
        cuts.append(F.transform(planes, _crossing(a[axis], b[axis], dim[axis], offset[axis])))
    ends = F.array(F.lit(0.0), F.lit(1.0))
    inside = F.filter(F.concat(*cuts), lambda t: (t > 0) & (t < 1))
    out = segments.withColumn("_t", F.array_sort(F.array_distinct(F.concat(ends, inside))))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_t") - 1),
        lambda n: F.struct(
            F.element_at("_t", n).alias("t0"), F.element_at("_t", n + 1).alias("t1")
        ),
    )
    out = out.select("*", F.posexplode(pairs).alias("piece", "_span")).drop("_t")
    t0, t1 = F.col("_span.t0"), F.col("_span.t1")
    mid = (t0 + t1) * F.lit(0.5)
    at_mid = [a[n] + mid * (b[n] - a[n]) for n in range(3)]
    length = geo.norm([b[n] - a[n] for n in range(3)])
    return out.select(
        "*",
        *[
            F.floor((at_mid[n] - offset[n]) / dim[n]).cast("int").alias(IJK[n])
            for n in range(3)
        ],
        (length * (t1 - t0)).alias("piece_length"),
        *[(a[n] + t0 * (b[n] - a[n])).alias(f"p{geo.AXES[n]}0") for n in range(3)],
        *[
            F.when(t1 == 1.0, b[n]).otherwise(a[n] + t1 * (b[n] - a[n])).alias(f"p{geo.AXES[n]}1")
            for n in range(3)
        ],
    ).drop("_span")


def grid_pieces(segments: DataFrame, grid: Grid, **ends: Sequence[str]) -> DataFrame:
    """:func:`voxel_pieces` on a fixed grid; pieces outside the grid are dropped."""
    pieces = voxel_pieces(
        segments, dim=[F.lit(d) for d in grid.dim], offset=[F.lit(o) for o in grid.offset], **ends
    )
    inside = F.lit(True)
    for n, name in enumerate(IJK):
        inside = inside & (F.col(name) >= 0) & (F.col(name) < grid.shape[n])
    return pieces.filter(inside)


def length_per_voxel(segments: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Length of each group's segments inside every voxel of a fixed grid."""
    return grid_pieces(segments, grid).groupBy(*keys, *IJK).agg(
        F.sum("piece_length").alias("length")
    )


def centred_grids(
    segments: DataFrame, roots: DataFrame, keys: Sequence[str], sizes: Sequence[Sequence[float]]
) -> DataFrame:
    """One grid per group and voxel size, shifted so that the root is mid-voxel.

    (keys, size_id, dim_x.., off_x.., n_x..): the shape covers the group's box in whole voxels,
    at least one, plus three.
    """
    ends = segments.select(*keys, *[F.col(f"{a}_to").alias(a) for a in geo.AXES]).unionByName(
        segments.select(*keys, *[F.col(f"{a}_from").alias(a) for a in geo.AXES])
    )
    box = bounding_box(ends, keys)
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("size_id"), *[F.lit(float(v)).alias(f"dim_{a}") for v, a in zip(s, geo.AXES)])
            for n, s in enumerate(sizes)
        ]
    )
    root = roots.select(*keys, *[F.col(a).alias(f"_r{a}") for a in geo.AXES])
    out = box.join(root, list(keys)).withColumn("_s", F.explode(listed)).select("*", "_s.*")
    for a in geo.AXES:
        dim, low = F.col(f"dim_{a}"), F.col(f"{a}_min")
        steps = (F.col(f"_r{a}") - low) / dim
        part = steps - F.floor(steps)
        out = out.withColumn(
            f"n_{a}", (F.greatest(F.floor((F.col(f"{a}_max") - low) / dim), F.lit(1)) + 3).cast("int")
        ).withColumn(f"off_{a}", low - (F.lit(1.5) - part) * dim)
    return out.select(
        *keys, "size_id",
        *[f"{p}_{a}" for p in ("dim", "off", "n") for a in geo.AXES],
    )


def length_maps(
    segments: DataFrame, grids: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Length per voxel of each group on each of its grids; pieces outside are dropped."""
    keys = list(keys)
    pieces = voxel_pieces(
        segments.join(grids, keys),
        dim=[F.col(f"dim_{a}") for a in geo.AXES],
        offset=[F.col(f"off_{a}") for a in geo.AXES],
    )
    inside = F.lit(True)
    for name, a in zip(IJK, geo.AXES):
        inside = inside & (F.col(name) >= 0) & (F.col(name) < F.col(f"n_{a}"))
    return (
        pieces.filter(inside).groupBy(*keys, "size_id", *IJK)
        .agg(F.sum("piece_length").alias("length"))
    )


def merge_runs(pieces: DataFrame, keys: Sequence[str], *, order: str = "piece", region: str = "region_id") -> DataFrame:
    """Merge consecutive pieces of equal region, then drop those without length.

    Returns (keys, run, region, x0 .. z1); ``run`` counts the remaining runs from 0.  A group is
    one segment, whose pieces all came out of one row, so a window over it is small.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((F.lag(region).over(w) != F.col(region)).cast("int"), F.lit(0))
    island = F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = pieces.withColumn(region, F.coalesce(region, F.lit(0))).withColumn("_change", change)
    first = F.struct("px0", "py0", "pz0")
    last = F.struct("px1", "py1", "pz1")
    runs = (
        marked.withColumn("_run", island)
        .groupBy(*keys, "_run")
        .agg(
            F.first(region).alias(region),
            F.min_by(first, order).alias("_a"),
            F.max_by(last, order).alias("_b"),
        )
        .select(
            *keys, "_run", region,
            *[F.col(f"_a.p{a}0").alias(f"{a}0") for a in geo.AXES],
            *[F.col(f"_b.p{a}1").alias(f"{a}1") for a in geo.AXES],
        )
        .filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")) | (F.col("z0") != F.col("z1")))
    )
    again = Window.partitionBy(*keys).orderBy("_run")
    return runs.withColumn("run", (F.row_number().over(again) - 1).cast("int")).drop("_run")


def cut_edges(
    nodes: DataFrame, edges: DataFrame, voxels: DataFrame, grid: Grid, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Cut edges where they pass from one region into another.

    ``nodes``: (keys, id, x, y, z, is_terminal, section_id, sub_segment_num); ``edges``: (keys,
    source, target).  Edges inside one region keep it, edges without length get region -1.
    New nodes continue the largest id of their tree and take their place in the numbering of
    their section.  Returns the new nodes (plus ``is_intermediate_pt``) and edges (keys, source,
    target, region_id).
    """
    keys = list(keys)
    ends = nodes.select(*keys, "id", *geo.AXES)

    def side(name: str, suffix: str) -> DataFrame:
        return ends.select(
            *keys, F.col("id").alias(name), *[F.col(a).alias(f"{a}_{suffix}") for a in geo.AXES]
        )

    placed = edges.select(*keys, "source", "target").join(
        side("source", "from"), [*keys, "source"]
    ).join(side("target", "to"), [*keys, "target"])
    pieces = voxel_pieces(
        placed, dim=[F.lit(d) for d in grid.dim], offset=[F.lit(o) for o in grid.offset]
    )
    valued = pieces.join(voxels.select(*IJK, "region_id"), list(IJK), "left")
    # a run but the last ends in a new node; an edge and its runs stay together for the count
    edge = [*keys, "source", "target"]
    runs = written(
        merge_runs(valued, edge).withColumn(
            "n_runs", F.count(F.lit(1)).over(Window.partitionBy(*edge))
        ).select(*edge, "run", "n_runs", "region_id", *[F.col(f"{a}1").alias(a) for a in geo.AXES]),
        "runs",
    )
    # all else is known of an edge: the runs are only met by one row of theirs
    cuts = runs.filter("run = 0").select(*edge, (F.col("n_runs") - 1).alias("_cuts"))
    top = nodes.groupBy(*keys).agg(F.max("id").alias("_top"))
    first = accumulate(
        cuts, keys, ["target", "source"], slice_by=id_slice("target"), sums={"_upto": F.col("_cuts")}
    ).join(top, keys)
    # the new node of an edge's run r has the id _at + r
    first = written(
        first.select(*edge, "_cuts", (F.col("_top") + F.col("_upto") - F.col("_cuts") + 1).alias("_at")),
        "cut-firsts",
    )
    many = F.col("n_runs") > 1
    cut = runs.filter(many).select(*edge, "run", "n_runs", "region_id").join(first, edge).select(
        *keys,
        F.when(F.col("run") == 0, F.col("source")).otherwise(F.col("_at") + F.col("run") - 1).alias("source"),
        F.when(F.col("run") == F.col("n_runs") - 1, F.col("target")).otherwise(F.col("_at") + F.col("run")).alias("target"),
        "region_id",
    )
    one = runs.filter(~many).select(*edge, "region_id")
    still = edges.select(*edge).join(first.select(*edge), edge, "left_anti").withColumn(
        "region_id", F.lit(-1).cast("bigint")
    )
    new_edges = cut.unionByName(one).unionByName(still)
    # shift the numbering of every node by the new nodes before it in its section
    added = first.groupBy(*keys, F.col("target").alias("id")).agg(F.sum("_cuts").alias("_cuts"))
    shifted = accumulate(
        nodes.join(added, [*keys, "id"], "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(0))),
        [*keys, "section_id"], ["sub_segment_num"], slice_by=id_slice("sub_segment_num"),
        sums={"_shift": F.col("_cuts")},
    )
    old = shifted.select(
        *keys, "id", *geo.AXES, "is_terminal", "section_id",
        (F.col("sub_segment_num") + F.col("_shift")).alias("sub_segment_num"),
        F.lit(False).alias("is_intermediate_pt"),
    )
    home = shifted.select(
        *keys, F.col("id").alias("target"), "section_id",
        (F.col("sub_segment_num") + F.col("_shift") - F.col("_cuts")).alias("_base"),
    )
    new = (
        runs.filter(F.col("run") < F.col("n_runs") - 1).select(*edge, "run", *geo.AXES)
        .join(first.select(*edge, "_at").join(home, [*keys, "target"]), edge)
        .select(
            *keys, (F.col("_at") + F.col("run")).alias("id"), *geo.AXES, F.lit(False).alias("is_terminal"),
            "section_id", (F.col("_base") + F.col("run")).alias("sub_segment_num"),
            F.lit(True).alias("is_intermediate_pt"),
        )
    )
    return old.unionByName(new), new_edges


# --- painting and building grids ----------------------------------------------------------


def paint(voxels: DataFrame, cells: DataFrame) -> DataFrame:
    """Overwrite the region of the listed cells (i, j, k, new_id); new cells are added."""
    new = cells.groupBy(*IJK).agg(F.max("new_id").alias("new_id"))
    return voxels.join(new, list(IJK), "full_outer").select(
        *IJK, F.coalesce("new_id", "region_id").alias("region_id")
    )


def paint_polyline(
    voxels: DataFrame, regions: DataFrame, segments: DataFrame, grid: Grid
) -> tuple[DataFrame, DataFrame]:
    """Mark every voxel a polyline crosses as one new region below the top region."""
    new_region = _next_region(regions, [("dft", "dummy_preferred_regions")])
    crossed = grid_pieces(segments, grid).filter("piece_length > 0").select(*IJK).distinct()
    cells = crossed.withColumn("new_id", new_region.select("id").scalar())
    return paint(voxels, cells), regions.unionByName(new_region)


def add_source_targets(
    voxels: DataFrame, regions: DataFrame, source: DataFrame, targets: DataFrame, grid: Grid,
    *, suffix: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Give the voxel of the source (x, y, z) and of each target (target_num, x, y, z) a region.

    Target numbers count from 0; a later target wins a shared voxel.
    """
    base = regions.agg(F.greatest(F.lit(1), F.max("id") + 1)).scalar()
    parent = regions.filter("parent_id = -1").agg(F.min("id")).scalar()
    pts = source.select(F.lit(-1).cast("bigint").alias("target_num"), *geo.AXES).unionByName(
        targets.select(F.col("target_num").cast("bigint").alias("target_num"), *geo.AXES)
    )
    placed = pts.withColumn("id", base + F.col("target_num") + 1).withColumn("parent_id", parent)
    is_source = F.col("target_num") == -1
    rows = placed.select(
        "id", "parent_id",
        F.when(is_source, F.lit("s")).otherwise(F.concat(F.lit("t_"), F.col("target_num").cast("string"))).alias("acronym"),
        F.when(is_source, F.lit(f"source_region{suffix}"))
        .otherwise(F.concat(F.lit(f"target_region{suffix}_"), F.col("target_num").cast("string"))).alias("name"),
    )
    cells = placed.select(*indices(geo.AXES, grid), F.col("id").alias("new_id"))
    return paint(voxels, cells), regions.unionByName(rows)


def _next_region(regions: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of new regions below the top one, with ids after the largest."""
    base = regions.agg(
        F.greatest(F.lit(1), F.max("id") + 1).alias("_base"),
        F.min(F.when(F.col("parent_id") == -1, F.col("id"))).alias("parent_id"),
    )
    names = F.array(*[F.struct(F.lit(a).alias("acronym"), F.lit(n).alias("name")) for a, n in labels])
    return base.select("*", F.posexplode(names).alias("_p", "_l")).select(
        (F.col("_base") + F.col("_p")).cast("bigint").alias("id"),
        F.col("parent_id"), "_l.acronym", "_l.name",
    )


def grid_for(
    points: DataFrame, keys: Sequence[str], dim: Sequence[float], *, buffer: float = 1.0
) -> DataFrame:
    """Every voxel of a grid sized to each group's box: (keys, i, j, k) and the grid columns."""
    box = bounding_box(points, keys, absolute_buffer=buffer)
    for n, a in enumerate(geo.AXES):
        steps = F.floor((F.col(f"{a}_max") - F.col(f"{a}_min")) / F.lit(float(dim[n])))
        box = box.withColumn(f"n_{a}", (F.greatest(steps, F.lit(1)) + 3).cast("int"))
    out = box.select(*keys, *[f"{a}_min" for a in geo.AXES], *[f"n_{a}" for a in geo.AXES])
    for name, a in zip(IJK, geo.AXES):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"n_{a}") - 1)))
    return out
