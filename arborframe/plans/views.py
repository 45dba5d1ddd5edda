"""Domain tables derived from the driver tables, each with the same definition in SQL.

``*_SQL`` strings hold common table expressions (without the WITH keyword) that plain SQL
engines can evaluate on the same parquet files; the DataFrame functions build the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborframe.functions.draws import uniform
from arborframe.operators.core import numbered, scratch_path
from arborframe.sources.tables import exists

# Codes of the neurite types in point tables.
SOMA, AXON, BASAL, APICAL = 1, 2, 3, 4

# Grid of the synthetic voxel space: cubic voxels, origin and extent per axis.
GRID_DIM = 10.0
GRID_OFF = -20.0
GRID_N = 14


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


_SHARED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table that several queries start from, written once per session.

    It is kept in the scratch folder and made again when its files are gone.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED or not exists(spark, f"{_SHARED[key][0]}/_SUCCESS"):
        path, df = scratch_path(spark, name), make()
        df.write.parquet(path)
        _SHARED[key] = (path, df.schema)
    path, schema = _SHARED[key]
    return spark.read.schema(schema).parquet(path)


def forget_shared() -> None:
    """Make every prepared table again on next use, so that timings stand alone."""
    _SHARED.clear()


def r6(value: Column, digits: int = 6) -> Column:
    """Rounded double whose zero has no sign."""
    return F.round(value, digits) + F.lit(0.0)


def r6s(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def u_sql(*parts: str) -> str:
    """SQL text of :func:`arborframe.functions.draws.uniform` (parts are SQL expressions)."""
    joined = ", ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::bigint / 4294967296.0::double)"


# --- hierarchy: root > regions > nations > customers and suppliers -------------------------

HIERARCHY_SQL = """
hierarchy as (
  select 1::bigint as id, -1::bigint as parent_id, 'root' as acronym, 'the whole' as name
  union all
  select 10 + r_regionkey, 1, 'R' || r_regionkey, r_name from region
  union all
  select 100 + n_nationkey, 10 + n_regionkey, 'N' || n_nationkey, n_name from nation
  union all
  select 1000 + 2 * c_custkey, 100 + c_nationkey, 'C' || c_custkey, c_name from customer
  union all
  select 1001 + 2 * s_suppkey, 100 + s_nationkey, 'S' || s_suppkey, s_name from supplier
)
"""


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    def rows(name: str, key: str, base: int, step: int, parent: Column, tag: str, label: str):
        return table(spark, sf, name).select(
            (F.lit(base) + F.lit(step) * F.col(key)).cast("bigint").alias("id"),
            parent.cast("bigint").alias("parent_id"),
            F.concat(F.lit(tag), F.col(key).cast("string")).alias("acronym"),
            F.col(label).alias("name"),
        )

    root = spark.range(1).select(
        F.lit(1).cast("bigint").alias("id"),
        F.lit(-1).cast("bigint").alias("parent_id"),
        F.lit("root").alias("acronym"),
        F.lit("the whole").alias("name"),
    )
    return (
        root.unionByName(rows("region", "r_regionkey", 10, 1, F.lit(1), "R", "r_name"))
        .unionByName(
            rows("nation", "n_nationkey", 100, 1, 10 + F.col("n_regionkey"), "N", "n_name")
        )
        .unionByName(
            rows("customer", "c_custkey", 1000, 2, 100 + F.col("c_nationkey"), "C", "c_name")
        )
        .unionByName(
            rows("supplier", "s_suppkey", 1001, 2, 100 + F.col("s_nationkey"), "S", "s_name")
        )
    )


# --- trees: one per user, points numbered by event --------------------------------------

_POINT_SQL = f"""
    case when n = 1 then -1 when n % 5 = 0 then n - 1 else n // 2 end::bigint as parent_id,
    (case event_type when 'click' then {AXON} when 'error' then {AXON}
       when 'purchase' then {BASAL} when 'signup' then {APICAL} else {AXON} end)::integer as type,
    100 * {u_sql("event_id", "'x'")} as x,
    100 * {u_sql("event_id", "'y'")} as y,
    100 * {u_sql("event_id", "'z'")} as z,
    0.5 + {u_sql("event_id", "'r'")} as radius
"""

POINTS_SQL = f"""
points as (
  select user_id::varchar as morphology, n as point_id, {_POINT_SQL}, event_id, event_type
  from (select *, row_number() over (partition by user_id order by event_id) as n from events)
)
"""

FOREST_SQL = f"""
forest as (
  select user_id::varchar as morphology, event_type as neurite, n as point_id, {_POINT_SQL},
    event_id
  from (select *, row_number() over (partition by user_id, event_type order by event_id) as n
        from events)
)
"""


def _points(numbered_events: DataFrame) -> DataFrame:
    n = F.col("point_id")
    kind = F.col("event_type")
    return numbered_events.select(
        "*",
        F.col("user_id").cast("string").alias("morphology"),
        F.when(n == 1, F.lit(-1))
        .when(F.pmod(n, F.lit(5)) == 0, n - 1)
        .otherwise(F.floor(n / 2))
        .cast("bigint")
        .alias("parent_id"),
        F.when(kind == "purchase", F.lit(BASAL))
        .when(kind == "signup", F.lit(APICAL))
        .otherwise(F.lit(AXON))
        .alias("type"),
        *[(F.lit(100) * uniform("event_id", F.lit(a))).alias(a) for a in "xyz"],
        (F.lit(0.5) + uniform("event_id", F.lit("r"))).alias("radius"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One tree per user; a point's parent is half its number, or the point before it."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = _points(numbered(events, ["user_id"], "event_id", "point_id", start=1))
    return out.drop("user_id")


def forest(spark: SparkSession, sf: str) -> DataFrame:
    """One tree per user and event type, keyed by (morphology, neurite)."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = _points(numbered(events, ["user_id", "event_type"], "event_id", "point_id", start=1))
    return out.withColumnRenamed("event_type", "neurite").drop("user_id")


# --- polylines: the points of a user in event order, one segment per consecutive pair -----

SEGMENTS_SQL = f"""
{POINTS_SQL},
segments as (
  select p.morphology, p.point_id as segment_id, q.x as x_from, q.y as y_from, q.z as z_from,
    p.x as x_to, p.y as y_to, p.z as z_to
  from points p join points q on p.morphology = q.morphology and p.parent_id = q.point_id
)
"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Tree edges with the coordinates of both ends."""
    p = points(spark, sf)
    up = p.select(
        "morphology",
        F.col("point_id").alias("parent_id"),
        *[F.col(a).alias(f"{a}_from") for a in "xyz"],
    )
    return p.join(up, ["morphology", "parent_id"]).select(
        "morphology",
        F.col("point_id").alias("segment_id"),
        "x_from", "y_from", "z_from",
        *[F.col(a).alias(f"{a}_to") for a in "xyz"],
    )


# --- point cloud ---------------------------------------------------------------------------

CLOUD_SQL = """
cloud as (
  select vec_id as id, label as grp, embedding[1]::double as x, embedding[2]::double as y,
    embedding[3]::double as z
  from embeddings
)
"""


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """First three embedding entries as points, grouped by label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("grp"),
        *[
            F.element_at("embedding", i + 1).cast("double").alias(a)
            for i, a in enumerate("xyz")
        ],
    )


# --- voxel space: a grid whose region ids come from nations ---------------------------------

VOXELS_SQL = f"""
{HIERARCHY_SQL},
voxels as (
  select i::integer as i, j::integer as j, k::integer as k, region_id
  from (
    select p_partkey % {GRID_N} + {GRID_N} * (p_partkey // {GRID_N ** 3}) as i, (p_partkey // {GRID_N}) % {GRID_N} as j,
      (p_partkey // {GRID_N * GRID_N}) % {GRID_N} as k,
      arg_min(case when p_size <= 10 then 0 when p_size <= 14 then 10 + p_size % 5
        else 100 + p_size % 25 end::bigint, p_partkey) as region_id
    from part group by 1, 2, 3)
)
"""


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse voxel grid (i, j, k, region_id), one cell per part.

    Parts fill blocks of ``GRID_N`` cells a side; the blocks follow each other along the first
    axis, so that the grid grows with the parts.
    """
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    n = GRID_N
    key = F.col("p_partkey")
    region = (
        F.when(F.col("p_size") <= 10, F.lit(0))
        .when(F.col("p_size") <= 14, F.lit(10) + F.col("p_size") % 5)
        .otherwise(F.lit(100) + F.col("p_size") % 25)
        .cast("bigint")
    )
    return part.groupBy(
        (key % n + n * F.floor(key / (n * n * n))).cast("int").alias("i"),
        (F.floor(key / n) % n).cast("int").alias("j"),
        (F.floor(key / (n * n)) % n).cast("int").alias("k"),
    ).agg(F.min_by(region, key).alias("region_id"))
