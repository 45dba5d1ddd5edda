"""Queries on region hierarchies and voxel grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import regions as R
from arborframe.operators import spatial as S
from arborframe.operators import trees as T
from arborframe.operators import voxels as V
from arborframe.operators.core import written
from arborframe.plans.ask_trees import SECTIONED_SQL, sectioned
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    GRID_DIM, GRID_N, GRID_OFF, HIERARCHY_SQL, POINTS_SQL, SEGMENTS_SQL, VOXELS_SQL,
    hierarchy, points, r6, r6s, segments, shared, table, u_sql, voxels,
)

shelf = Shelf()
M = "morphology"
IJK = ["i", "j", "k"]
GRID = V.Grid((GRID_DIM,) * 3, (GRID_OFF,) * 3, (GRID_N,) * 3)

# --- hierarchy ----------------------------------------------------------------------------

CLOSURE = f"""
{HIERARCHY_SQL},
above as (
  select id, id as elder_id, parent_id as nxt, 0 as steps from hierarchy
  union all
  select a.id, h.id, h.parent_id, a.steps + 1 from above a join hierarchy h on h.id = a.nxt
),
levels as (select id, max(steps)::integer as st_level from above group by 1)
"""


def idx_sql(c: str) -> str:
    return f"floor(({c} - ({GRID_OFF})) / {GRID_DIM})::integer"


LOOKUP_SQL = f"""
{VOXELS_SQL}, {POINTS_SQL},
looked as (select p.*, v.region_id from points p left join voxels v
  on v.i = {idx_sql("p.x")} and v.j = {idx_sql("p.y")} and v.k = {idx_sql("p.z")})
"""


@shelf.add("v03_levels", f"with recursive {CLOSURE} select h.id, h.parent_id, h.acronym, st_level from hierarchy h join levels using (id)")
def v03(spark, sf):
    return R.with_level(hierarchy(spark, sf)).select("id", "parent_id", "acronym", "st_level")


def youths(spark, sf):
    return shared(spark, sf, "youths", lambda: R.descendants(hierarchy(spark, sf)))


def elders(spark, sf):
    return shared(spark, sf, "elders", lambda: R.ascendants(hierarchy(spark, sf)))


@shelf.add("v04_descendants", f"""with recursive {CLOSURE}
    select elder_id as id, a.id as youth_id, st_level from above a join levels l on l.id = a.id""")
def v04(spark, sf):
    return R.descendants(hierarchy(spark, sf))


@shelf.add("v05_ascendants", f"""with recursive {CLOSURE}
    select a.id, elder_id, st_level from above a join levels l on l.id = a.elder_id""")
def v05(spark, sf):
    return R.ascendants(hierarchy(spark, sf))


ASKED_SQL = """
asked as (
  select n_name as key from nation union all select 'R' || r_regionkey from region
  union all select (1000 + 2 * c_custkey)::varchar from customer where c_mktsegment = 'BUILDING'
  union all select distinct event_type from events union all select '0' from region
),
keys as (select distinct key, try_cast(key as bigint) as num from asked),
hits as (
  select key, h.id from keys join hierarchy h on h.id = num
  union all select key, h.id from keys join hierarchy h on h.name = key where num is null
  union all select key, h.id from keys join hierarchy h on h.acronym = key where num is null
)
"""


def asked(spark, sf):
    return (
        table(spark, sf, "nation").select(F.col("n_name").alias("key"))
        .unionByName(table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("key")))
        .unionByName(
            table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
            .select((F.lit(1000) + 2 * F.col("c_custkey")).cast("string").alias("key"))
        )
        .unionByName(table(spark, sf, "events").select(F.col("event_type").alias("key")).distinct())
        .unionByName(table(spark, sf, "region").select(F.lit("0").alias("key")))
    )


@shelf.add("v06_resolved_ids", f"""with recursive {CLOSURE}, {ASKED_SQL}
    select 'found' as state, a.id::varchar as key from (select distinct a.id from hits join above a on a.elder_id = hits.id) a
    union all select 'missing', key from keys where key not in (select key from hits)""")
def v06(spark, sf):
    regions = hierarchy(spark, sf)
    found, missing = R.resolve(asked(spark, sf), regions, youths(spark, sf))
    return found.select(F.lit("found").alias("state"), F.col("id").cast("string").alias("key")).unionByName(
        missing.select(F.lit("missing").alias("state"), "key")
    )


WANTED_SQL = """
wanted as (select r_name as key from region where r_name < 'B' union all select '0' from region),
ids as (
  select a.id from wanted w join hierarchy h on h.name = w.key join above a on a.elder_id = h.id
  union select 0
)
"""


def wanted(spark, sf):
    region = table(spark, sf, "region")
    return region.filter("r_name < 'B'").select(F.col("r_name").alias("key")).unionByName(
        region.select(F.lit("0").alias("key"))
    )


@shelf.add("v07_region_voxels", f"""with recursive {CLOSURE}, {VOXELS_SQL.replace(HIERARCHY_SQL + ",", "")}, {WANTED_SQL}
    select i, j, k, region_id, region_id in (select id from ids) as inside from voxels""")
def v07(spark, sf):
    regions, grid = hierarchy(spark, sf), voxels(spark, sf)
    found, missing = R.resolve(wanted(spark, sf), regions, youths(spark, sf))
    inside = R.voxels_in(grid, found, missing).withColumn("inside", F.lit(True))
    outside = R.voxels_in(grid, found, missing, inverse=True).withColumn("inside", F.lit(False))
    return inside.unionByName(outside).select(*IJK, "region_id", "inside")


@shelf.add("v08_region_masks", f"""with recursive {CLOSURE}, {VOXELS_SQL.replace(HIERARCHY_SQL + ",", "")}
    select a.elder_id as mask_id, count(v.i) as n_voxels, coalesce(sum(v.i * 10000 + v.j * 100 + v.k), 0)::bigint as cells
    from above a left join voxels v on v.region_id = a.id group by 1""")
def v08(spark, sf):
    closure = youths(spark, sf)
    mask, empty = R.masks(voxels(spark, sf), closure)
    flat = (F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).cast("bigint")
    return (
        mask.groupBy("mask_id").agg(F.count(F.lit(1)).alias("n_voxels"), F.sum(flat).alias("cells"))
        .unionByName(empty.select("mask_id", F.lit(0).cast("bigint").alias("n_voxels"), F.lit(0).cast("bigint").alias("cells")))
    )


@shelf.add("v16_region_volumes", f"""with recursive {CLOSURE}, {VOXELS_SQL.replace(HIERARCHY_SQL + ",", "")}
    select a.elder_id as id, count(v.i) as nb_voxels, count(v.i) * {GRID_DIM ** 3} :: double as volume
    from above a left join voxels v on v.region_id = a.id group by 1""")
def v16(spark, sf):
    return R.volumes(voxels(spark, sf), youths(spark, sf), GRID.voxel_volume)


@shelf.add("v23_first_nested_region", f"""with recursive {CLOSURE},
    known as (select 10 + r_regionkey as id from region where r_name < 'B'
      union select 100 + n_nationkey from nation where n_regionkey >= 2),
    ask as (select id from hierarchy union all select -s_suppkey from supplier),
    best as (select a.id, arg_min(elder_id, steps) as e from above a where elder_id in (select id from known) group by 1)
    select ask.id, case when ask.id <= 0 then ask.id else coalesce(e, ask.id) end as nested_id
    from ask left join best on best.id = ask.id""")
def v23(spark, sf):
    regions = hierarchy(spark, sf)
    known = (
        table(spark, sf, "region").filter("r_name < 'B'").select((10 + F.col("r_regionkey")).cast("bigint").alias("id"))
        .unionByName(table(spark, sf, "nation").filter("n_regionkey >= 2").select((100 + F.col("n_nationkey")).cast("bigint").alias("id")))
    )
    ask = regions.select("id").unionByName(table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("id")))
    return R.first_nested(ask, known, elders(spark, sf))


@shelf.add("e07_parent_and_children", f"""with {HIERARCHY_SQL}
    select h.id, h.acronym, p.acronym as acronym_parent, count(c.id) as n_children, min(c.acronym) as first_child
    from hierarchy h left join hierarchy p on p.id = h.parent_id left join hierarchy c on c.parent_id = h.id group by all""")
def e07(spark, sf):
    regions = hierarchy(spark, sf)
    kids = R.child_acronyms(regions).groupBy(F.col("region_acronym").alias("acronym")).agg(
        F.count(F.lit(1)).alias("n"), F.min("subregion_acronym").alias("first_child"))
    return R.parent_acronyms(regions).join(kids, "acronym", "left").select(
        "id", "acronym", "acronym_parent", F.coalesce("n", F.lit(0)).alias("n_children"), "first_child")


# --- points and voxels -----------------------------------------------------------------------


@shelf.add("v01_voxel_lookup", f"with {LOOKUP_SQL} select morphology, point_id, region_id from looked")
def v01(spark, sf):
    return V.lookup(points(spark, sf), voxels(spark, sf), GRID, ["region_id"]).select(M, "point_id", "region_id")


@shelf.add("v02_voxel_centres", f"""with {VOXELS_SQL} select i, j, k, (i + 0.5) * {GRID_DIM}::double + ({GRID_OFF}) as x,
    (j + 0.5) * {GRID_DIM}::double + ({GRID_OFF}) as y, (k + 0.5) * {GRID_DIM}::double + ({GRID_OFF}) as z from voxels""")
def v02(spark, sf):
    return voxels(spark, sf).select(*IJK, *V.centres(GRID))


@shelf.add("v09_region_points", f"""with {VOXELS_SQL},
    req as (select o_orderkey, 100 + c_nationkey as region_id from orders join customer on c_custkey = o_custkey),
    rows as (select *, row_number() over (partition by region_id order by i, j, k) - 1 as rn,
      count(*) over (partition by region_id) as n from voxels)
    select o_orderkey, req.region_id::bigint as region_id, i, j, k,
      {r6s(f"(i + 0.5) * {GRID_DIM} + ({GRID_OFF}) + ({u_sql('o_orderkey', chr(39) + 'shift_x' + chr(39))} - 0.5) * {GRID_DIM}")} as x,
      {r6s(f"(k + 0.5) * {GRID_DIM} + ({GRID_OFF}) + ({u_sql('o_orderkey', chr(39) + 'shift_z' + chr(39))} - 0.5) * {GRID_DIM}")} as z
    from req join rows on rows.region_id = req.region_id
      and rn = floor({u_sql('o_orderkey', chr(39) + 'voxel' + chr(39))} * n)""")
def v09(spark, sf):
    req = table(spark, sf, "orders").join(
        table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    ).select("o_orderkey", (F.lit(100) + F.col("c_nationkey")).cast("bigint").alias("region_id"))
    out = V.region_points(voxels(spark, sf), req, GRID, region="region_id", request="o_orderkey")
    return out.select("o_orderkey", "region_id", *IJK, r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


FRONTIER = GRID.frontier(2)


@shelf.add("v10_hemispheres", f"""with {POINTS_SQL} select morphology, point_id,
    case when z < {FRONTIER} then 'L' else 'R' end as side from points""")
def v10(spark, sf):
    return points(spark, sf).select(M, "point_id", V.hemisphere(F.col("z"), GRID).alias("side"))


@shelf.add("v11_mirrored_points", f"""with {POINTS_SQL} select morphology, point_id,
    {r6s(f"case when event_type in ('click', 'error') and z >= {FRONTIER} or event_type = 'view' and z < {FRONTIER} then {2 * FRONTIER} - z else z end")} as z
    from points""")
def v11(spark, sf):
    kind = F.col("event_type")
    side = F.when(kind.isin("click", "error"), F.lit("L")).when(kind == "view", F.lit("R"))
    return points(spark, sf).select(M, "point_id", r6(V.into_hemisphere(F.col("z"), side, GRID)).alias("z"))


HEIGHTS_SQL = f"""
heights as (select i, j, k, (j + 0.5) * {GRID_DIM} + ({GRID_OFF}) as y,
  max((j + 1) * {GRID_DIM} + ({GRID_OFF})) over (partition by i, k) as pia from voxels),
depths as (select i, j, k, pia - y as depth from heights)
"""


def depths(spark, sf):
    grid = voxels(spark, sf)
    tops = grid.groupBy("i", "k").agg(F.max((F.col("j") + 1) * F.lit(GRID_DIM) + F.lit(GRID_OFF)).alias("pia"))
    return V.depth(grid.join(tops, ["i", "k"]).select("*", *V.centres(GRID)))


@shelf.add("v12_depth_field", f"with {VOXELS_SQL}, {HEIGHTS_SQL} select i, j, k, depth::double as depth from depths")
def v12(spark, sf):
    return depths(spark, sf)


@shelf.add("v15_allowed_points", f"""with {LOOKUP_SQL}
    select morphology, point_id from looked where region_id is null or region_id not in
      (select 100 + n_nationkey from nation where n_regionkey = 1)""")
def v15(spark, sf):
    bad = table(spark, sf, "nation").filter("n_regionkey = 1").select((100 + F.col("n_nationkey")).cast("bigint").alias("region_id"))
    return V.drop_forbidden(points(spark, sf), voxels(spark, sf), bad, GRID).select(M, "point_id")


@shelf.add("v17_layers", f"""with {LOOKUP_SQL}
    select morphology, point_id, coalesce(n_regionkey + 1, 0)::integer as layer from looked
    left join nation on region_id = 100 + n_nationkey""")
def v17(spark, sf):
    layer = table(spark, sf, "nation").select((100 + F.col("n_nationkey")).cast("bigint").alias("region_id"), (F.col("n_regionkey") + 1).alias("layer"))
    return V.layers(points(spark, sf), voxels(spark, sf), layer, GRID).select(M, "point_id", "layer")


def rotation_field(spark, sf):
    a = F.when(F.col("region_id") == 0, F.lit(float("nan"))).otherwise(F.radians(F.col("region_id").cast("double")))
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [[F.cos(a), -F.sin(a), zero], [F.sin(a), F.cos(a), zero], [zero, zero, one]]
    return voxels(spark, sf).select(*IJK, F.array(*[F.array(*r) for r in rows]).alias("rotation"))


@shelf.add("v18_orientations", f"""with {LOOKUP_SQL}
    select morphology, point_id, {r6s("case when coalesce(region_id, 0) = 0 then 1 else cos(radians(region_id)) end")} as r00,
      {r6s("case when coalesce(region_id, 0) = 0 then 0 else -sin(radians(region_id)) end")} as r01, 1.0::double as r22 from looked""")
def v18(spark, sf):
    m = F.col("rotation")
    return V.orientations(points(spark, sf), rotation_field(spark, sf), GRID).select(
        M, "point_id", r6(m[0][0]).alias("r00"), r6(m[0][1]).alias("r01"), r6(m[2][2]).alias("r22"))


# --- segments ----------------------------------------------------------------------------------


def _cuts(axis: str) -> str:
    lo = f"floor((least({axis}_from, {axis}_to) - ({GRID_OFF})) / {GRID_DIM})::bigint"
    hi = f"floor((greatest({axis}_from, {axis}_to) - ({GRID_OFF})) / {GRID_DIM})::bigint"
    return f"""select morphology, segment_id, ({GRID_OFF}::double + p * {GRID_DIM}::double - {axis}_from) / ({axis}_to - {axis}_from) as t
      from (select *, unnest(generate_series({lo} + 1, {hi})) as p from segments)"""


def pieces_sql(base: str) -> str:
    at = ", ".join(
        f"floor((({a}_from + m * ({a}_to - {a}_from)) - ({GRID_OFF})) / {GRID_DIM})::integer as {n}"
        for a, n in zip("xyz", "ijk")
    )
    ends = ", ".join(
        f"{a}_from + t0 * ({a}_to - {a}_from) as p{a}0, case when t1 = 1 then {a}_to else {a}_from + t1 * ({a}_to - {a}_from) end as p{a}1"
        for a in "xyz"
    )
    return f"""
{base.replace("segments as (", "segments as materialized (")},
cuts as (
  select distinct * from (
    {_cuts("x")} union all {_cuts("y")} union all {_cuts("z")}) where t > 0 and t < 1
  union all select morphology, segment_id, 0.0::double from segments
  union all select morphology, segment_id, 1.0::double from segments
),
spans as (
  select *, (t0 + t1) * 0.5 as m, row_number() over w - 1 as piece from (
    select morphology, segment_id, t as t0, lead(t) over (partition by morphology, segment_id order by t) as t1 from cuts)
  where t1 is not null window w as (partition by morphology, segment_id order by t0)
),
pieces as materialized (
  select morphology, segment_id, piece::integer as piece, {at}, {ends},
    sqrt((x_to - x_from) * (x_to - x_from) + (y_to - y_from) * (y_to - y_from) + (z_to - z_from) * (z_to - z_from)) * (t1 - t0) as piece_length
  from spans join segments using (morphology, segment_id)
)
"""


PIECES_SQL = pieces_sql(SEGMENTS_SQL)


@shelf.add("v19_voxel_pieces", f"with {PIECES_SQL} select morphology, segment_id, piece, i, j, k, {r6s('piece_length')} as piece_length, {r6s('px0')} as px0, {r6s('pz1')} as pz1 from pieces")
def v19(spark, sf):
    return V.grid_pieces(segments(spark, sf), GRID).select(
        M, "segment_id", "piece", *IJK, *[r6(F.col(c)).alias(c) for c in ("piece_length", "px0", "pz1")])


@shelf.add("v20_voxel_length", f"with {PIECES_SQL} select morphology, i, j, k, {r6s('sum(piece_length)')} as length from pieces group by 1, 2, 3, 4")
def v20(spark, sf):
    return V.length_per_voxel(segments(spark, sf), [M], GRID).select(M, *IJK, r6(F.col("length")).alias("length"))


RUNS_SQL = f"""
{pieces_sql(SEGMENTS_SQL + "," + VOXELS_SQL)},
valued as (select p.*, coalesce(region_id, 0) as region_id from pieces p left join voxels using (i, j, k)),
flag as (select *, case when lag(region_id) over w <> region_id then 1 else 0 end as ch from valued
  window w as (partition by morphology, segment_id order by piece)),
isl as (select *, sum(ch) over (partition by morphology, segment_id order by piece) as isl from flag),
raw as (select morphology, segment_id, isl, first(region_id) as region_id,
    arg_min(px0, piece) as x0, arg_min(py0, piece) as y0, arg_min(pz0, piece) as z0,
    arg_max(px1, piece) as x1, arg_max(py1, piece) as y1, arg_max(pz1, piece) as z1
  from isl group by 1, 2, 3),
runs as materialized (select *, (row_number() over (partition by morphology, segment_id order by isl) - 1)::integer as run
  from raw where x0 <> x1 or y0 <> y1 or z0 <> z1)
"""


@shelf.add("v21_region_runs", f"with {RUNS_SQL} select morphology, segment_id, run, region_id, {r6s('x0')} as x0, {r6s('y1')} as y1, {r6s('z1')} as z1 from runs")
def v21(spark, sf):
    pieces = V.grid_pieces(segments(spark, sf), GRID).join(voxels(spark, sf), IJK, "left")
    return V.merge_runs(pieces, [M, "segment_id"]).select(
        M, "segment_id", "run", "region_id", *[r6(F.col(c)).alias(c) for c in ("x0", "y1", "z1")])


CUT_SQL = f"""
{RUNS_SQL}, {SECTIONED_SQL.replace(POINTS_SQL.replace("points as (", "points as materialized ("), "").lstrip().lstrip(",")},
nodes as materialized (select morphology, case when parent_id = -1 then -1 else point_id end as id, section_id, sub_segment_num from sectioned),
cnt as materialized (select morphology, segment_id, count(*) as n from runs group by 1, 2),
joints as materialized (select r.*, row_number() over (partition by morphology order by segment_id, run) as rn
  from runs r join cnt using (morphology, segment_id) where run < n - 1),
top as (select morphology, max(id) as top from nodes group by 1),
fresh as materialized (select j.*, top + rn as new_id from joints j join top using (morphology)),
shift as (select n.*, coalesce(c.n - 1, 0) as cuts,
    sum(coalesce(c.n - 1, 0)) over (partition by n.morphology, section_id order by sub_segment_num) as sh
  from nodes n left join cnt c on c.morphology = n.morphology and c.segment_id = n.id)
"""


def _cut(spark, sf):
    nodes, edges = T.nodes_and_edges(sectioned(spark, sf))
    cut = V.cut_edges(written(nodes, "nodes"), written(edges, "edges"), voxels(spark, sf), GRID, [M])
    return tuple(shared(spark, sf, f"cut-{n}", lambda t=t: t) for n, t in zip(("nodes", "edges"), cut))


@shelf.add("v22_cut_nodes", f"""with recursive {CUT_SQL}
    select morphology, id, section_id, (sub_segment_num + sh)::bigint as sub_segment_num, false as is_intermediate_pt from shift
    union all select f.morphology, new_id, s.section_id, (s.sub_segment_num + s.sh - s.cuts + f.run)::bigint, true
    from fresh f join shift s on s.morphology = f.morphology and s.id = f.segment_id""")
def v22_nodes(spark, sf):
    nodes, _ = _cut(spark, sf)
    return nodes.select(M, "id", "section_id", "sub_segment_num", "is_intermediate_pt")


@shelf.add("v22_cut_edges", f"""with recursive {CUT_SQL},
    ends as (select p.morphology, p.point_id as segment_id, case when q.parent_id = -1 then -1 else p.parent_id end as source
      from points p join points q on q.morphology = p.morphology and q.point_id = p.parent_id)
    select r.morphology, coalesce(b.new_id, e.source) as source, coalesce(a.new_id, r.segment_id) as target, r.region_id
    from runs r join ends e using (morphology, segment_id)
    left join fresh a on a.morphology = r.morphology and a.segment_id = r.segment_id and a.run = r.run
    left join fresh b on b.morphology = r.morphology and b.segment_id = r.segment_id and b.run = r.run - 1
    union all select e.morphology, e.source, e.segment_id, -1 from ends e
    where not exists (select 1 from runs r where r.morphology = e.morphology and r.segment_id = e.segment_id)""")
def v22_edges(spark, sf):
    _, edges = _cut(spark, sf)
    return edges


@shelf.add("v24_painted_regions", f"""with {pieces_sql(SEGMENTS_SQL + "," + VOXELS_SQL)},
    hit as (select distinct i, j, k from pieces where piece_length > 0 and greatest(i, j, k) < {GRID_N} and least(i, j, k) >= 0)
    select i, j, k, case when h.i is not null then (select max(id) + 1 from hierarchy) else region_id end::bigint as region_id
    from voxels v full join hit h using (i, j, k)""")
def v24(spark, sf):
    painted, _ = V.paint_polyline(voxels(spark, sf), hierarchy(spark, sf), segments(spark, sf), GRID)
    return painted


@shelf.add("v24_source_targets", f"""with {VOXELS_SQL}, {POINTS_SQL},
    pts as (select row_number() over (order by event_id) - 2 as num, x, y, z from points),
    cells as (select {idx_sql("x")} as i, {idx_sql("y")} as j, {idx_sql("z")} as k, max(num) as num from pts group by 1, 2, 3)
    select i, j, k, coalesce((select max(id) + 1 from hierarchy) + num + 1, region_id) as region_id
    from voxels full join cells using (i, j, k)""")
def v24_targets(spark, sf):
    from arborframe.operators.core import numbered

    pts = numbered(points(spark, sf).withColumn("_all", F.lit(1)), ["_all"], "event_id", "num", start=-1)
    pts = written(pts.select("num", "x", "y", "z"), "numbered")
    painted, _ = V.add_source_targets(
        voxels(spark, sf), hierarchy(spark, sf), pts.filter("num = -1").select("x", "y", "z"),
        pts.filter("num >= 0").select(F.col("num").alias("target_num"), "x", "y", "z"), GRID)
    return painted


@shelf.add("v25_sized_grids", f"""with {POINTS_SQL},
    b as (select morphology, min(x) - 1 as x0, max(x) + 1 as x1, min(y) - 1 as y0, max(y) + 1 as y1, min(z) - 1 as z0, max(z) + 1 as z1 from points group by 1),
    s as (select morphology, {", ".join(f"(greatest(floor(({a}1 - {a}0) / 25), 1) + 3)::integer as n{a}" for a in "xyz")} from b),
    gi as (select *, unnest(generate_series(0, nx - 1)) as i from s),
    gj as (select *, unnest(generate_series(0, ny - 1)) as j from gi)
    select morphology, i::integer as i, j::integer as j, unnest(generate_series(0, nz - 1))::integer as k from gj""")
def v25(spark, sf):
    return V.grid_for(points(spark, sf), [M], (25.0, 25.0, 25.0)).select(M, *IJK)


# --- boundary field ----------------------------------------------------------------------------

BOUNDARY_SQL = f"""
{VOXELS_SQL},
side as materialized (select *, region_id = 0 as outside, (i * {GRID_N} + j) * {GRID_N} + k as flat from voxels),
near as materialized (select a.i, a.j, a.k, a.outside,
    arg_min(b.flat, ((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j) + (a.k-b.k)*(a.k-b.k)) * 100000 + b.flat) as f
  from side a join side b on a.outside <> b.outside group by 1, 2, 3, 4),
raw as (select *, (i - f // {GRID_N * GRID_N}) * {GRID_DIM} as dx, (j - (f // {GRID_N}) % {GRID_N}) * {GRID_DIM} as dy, (k - f % {GRID_N}) * {GRID_DIM} as dz from near),
bound as materialized (select i, j, k,
   case when outside then -1e-3 * dx / sqrt(dx*dx + dy*dy + dz*dz) else dx end::double as vx,
   case when outside then -1e-3 * dy / sqrt(dx*dx + dy*dy + dz*dz) else dy end::double as vy,
   case when outside then -1e-3 * dz / sqrt(dx*dx + dy*dy + dz*dz) else dz end::double as vz from raw)
"""


def boundary(spark, sf):
    from arborframe.operators.fields import boundary_vectors

    return shared(spark, sf, "boundary", lambda: boundary_vectors(voxels(spark, sf), GRID, outside=0))


@shelf.add("v13_boundary_vectors", f"with {BOUNDARY_SQL} select i, j, k, {r6s('vx')} as vx, {r6s('vy')} as vy, {r6s('vz')} as vz from bound")
def v13(spark, sf):
    return boundary(spark, sf).select(*IJK, *[r6(F.col(c)).alias(c) for c in ("vx", "vy", "vz")])


@shelf.add("v14_smoothed_vectors", f"""with {BOUNDARY_SQL},
    d as (select unnest([-1, 0, 1]) as d),
    ext as (select min(i) i0, max(i) i1, min(j) j0, max(j) j1, min(k) k0, max(k) k1 from bound),
    near27 as (select b.i, b.j, b.k, least(greatest(b.i + a.d, i0), i1) as ni, least(greatest(b.j + c.d, j0), j1) as nj,
      least(greatest(b.k + e.d, k0), k1) as nk, case when a.d = 0 and c.d = 0 and e.d = 0 then 2 else 1 end as w
      from bound b, d a, d c, d e, ext),
    conv as (select n.i, n.j, n.k, sum(w * v.vx) / 28 as sx, sum(w * v.vy) / 28 as sy, sum(w * v.vz) / 28 as sz
      from near27 n join bound v on v.i = ni and v.j = nj and v.k = nk group by 1, 2, 3)
    select i, j, k, {", ".join(f"{r6s(f'case when sx*sx+sy*sy+sz*sz > 1e-18 then s{a} * sqrt(vx*vx+vy*vy+vz*vz) / sqrt(sx*sx+sy*sy+sz*sz) end', 5)} as v{a}" for a in "xyz")}
    from conv join bound using (i, j, k)""")
def v14(spark, sf):
    from arborframe.operators.fields import smooth_vectors

    out = smooth_vectors(boundary(spark, sf))
    return out.select(*IJK, *[r6(F.col(c), 5).alias(c) for c in ("vx", "vy", "vz")])
