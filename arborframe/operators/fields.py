"""Vector fields on voxel grids: direction to the boundary and its smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators.neighbours import neighbours
from arborframe.operators.voxels import IJK, Grid

# Length given to vectors of outside voxels, and the smoothing weights.
OUTSIDE_LENGTH = 1e-3
CENTRE_WEIGHT, OTHER_WEIGHT = 2.0, 1.0

# A smoothed vector shorter than this has cancelled out and keeps no direction.
CANCELLED = 1e-9


def boundary_vectors(voxels: DataFrame, grid: Grid, *, outside: int) -> DataFrame:
    """Vector field (i, j, k, vx, vy, vz) away from the border of the outside region.

    Inside voxels get the vector from the nearest outside voxel; outside voxels a very short
    vector towards the nearest inside voxel.  Of several nearest voxels the first in (i, j, k)
    order counts.
    """
    flat = (F.col("i") * F.lit(grid.shape[1]) + F.col("j")) * F.lit(grid.shape[2]) + F.col("k")
    cells = voxels.select(
        *IJK, flat.cast("bigint").alias("id"), (F.col("region_id") == outside).alias("_out"),
        *[F.col(n).cast("double").alias(a) for n, a in zip(IJK, geo.AXES)],
    )
    sides = []
    for is_out in (False, True):
        own = cells.filter(F.col("_out") == is_out)
        near = neighbours(own, cells.filter(F.col("_out") != is_out), [])
        joined = own.join(near, "id")
        v = [
            (F.col(a) - F.col(f"near_{a}")) * F.lit(d) for a, d in zip(geo.AXES, grid.dim)
        ]
        if is_out:
            v = [c * F.lit(-OUTSIDE_LENGTH) for c in geo.unit(v)]
        sides.append(joined.select(*IJK, *[c.alias(f"v{a}") for c, a in zip(v, geo.AXES)]))
    return sides[0].unionByName(sides[1])


def smooth_vectors(field: DataFrame) -> DataFrame:
    """Average each vector with its 26 neighbours (own weight 2) and restore its length.

    Neighbours beyond the border of the grid are those of the border voxel itself.  Every voxel
    sends 27 weighted copies; the border index is one row that every task can hold.
    """
    span = field.agg(*[F.min(n).alias(f"{n}0") for n in IJK], *[F.max(n).alias(f"{n}1") for n in IJK])
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    weight = lambda s: CENTRE_WEIGHT if s == (0, 0, 0) else OTHER_WEIGHT
    listed = F.array(
        *[
            F.struct(*[F.lit(v).alias(f"d{n}") for v, n in zip(s, IJK)], F.lit(weight(s)).alias("w"))
            for s in steps
        ]
    )
    bounds = {f"{n}{e}": span.select(f"{n}{e}").scalar() for n in IJK for e in "01"}
    asks = field.select(*IJK).withColumns({f"_{k}": v for k, v in bounds.items()}).withColumn(
        "_s", F.explode(listed)
    )
    for n in IJK:
        asks = asks.withColumn(
            f"_n{n}",
            F.least(F.greatest(F.col(n) + F.col(f"_s.d{n}"), F.col(f"_{n}0")), F.col(f"_{n}1")),
        )
    values = field.select(*[F.col(n).alias(f"_n{n}") for n in IJK], "vx", "vy", "vz")
    total = sum(weight(s) for s in steps)
    conv = (
        asks.join(values, [f"_n{n}" for n in IJK])
        .groupBy(*IJK)
        .agg(*[(F.sum(F.col("_s.w") * F.col(f"v{a}")) / F.lit(total)).alias(f"_s{a}") for a in geo.AXES])
    )
    old = geo.norm([F.col(f"v{a}") for a in geo.AXES])
    new = geo.norm([F.col(f"_s{a}") for a in geo.AXES])
    return field.join(conv, list(IJK)).select(
        *IJK, *[F.when(new > CANCELLED, F.col(f"_s{a}") * old / new).alias(f"v{a}") for a in geo.AXES]
    )
