"""Queries on terminal clustering and on distances between points."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.operators import clustering as C
from arborframe.operators import regions as R
from arborframe.operators import spatial as S
from arborframe.operators import trees as T
from arborframe.operators import tufts as TU
from arborframe.operators.core import numbered, written
from arborframe.operators.neighbours import nearest_distance
from arborframe.plans.ask_trees import CLOSURE_SQL, SECTIONS_SQL, section_table
from arborframe.plans.ask_voxels import CUT_SQL, GRID, _cut, elders, idx_sql, rotation_field
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    CLOUD_SQL, FOREST_SQL, POINTS_SQL, VOXELS_SQL, cloud, forest, points, r6, r6s, shared, table, u_sql,
    voxels,
)

shelf = Shelf()
M = "morphology"
RADIUS = 0.12
WIDE = 0.6


def near_sql(radius: float) -> str:
    return f"""
{CLOUD_SQL.replace("cloud as (", "cloud as materialized (")},
near as materialized (select a.grp, a.id as a, b.id as b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as distance
  from cloud a join cloud b on a.grp = b.grp and a.id <> b.id
  where sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= {radius}),
reach as (select grp, id as a, id as b from cloud union select r.grp, r.a, n.b from reach r join near n on n.grp = r.grp and n.a = r.b),
comp as materialized (select grp, a as id, min(b) as component from reach group by 1, 2)
"""


@shelf.add("c02_pairs_within_radius", f"with recursive {near_sql(RADIUS)} select grp, a, b, {r6s('distance')} as distance from near where a < b")
def c02(spark, sf):
    return S.pairs_within(cloud(spark, sf), ["grp"], RADIUS).withColumn("distance", r6(F.col("distance")))


@shelf.add("c03_pair_components", f"with recursive {near_sql(RADIUS)} select * from comp")
def c03(spark, sf):
    pts = cloud(spark, sf)
    found = S.components(S.pairs_within(pts, ["grp"], RADIUS), ["grp"])
    return S.label_all(pts, found, ["grp"]).select("grp", "id", "component")


@shelf.add("c03_close_components", f"with recursive {near_sql(RADIUS)} select * from comp")
def c03_close(spark, sf):
    return S.close_components(cloud(spark, sf), ["grp"], RADIUS, crowd=16)


def members_sql(radius: float, size: int) -> str:
    return f"""
{near_sql(radius)},
lab as (select *, dense_rank() over (partition by grp order by component) - 1 as label from comp),
ctr as (select grp, label, count(*) as size, avg(x) cx, avg(y) cy, avg(z) cz from lab join cloud using (grp, id) group by 1, 2),
mem0 as (select l.grp, l.id, l.label, c.size, x, y, z, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) as distance
  from lab l join cloud using (grp, id) join ctr c on c.grp = l.grp and c.label = l.label),
mem as materialized (select *, size >= {size} and count(*) filter (distance <= {radius}) over (partition by grp, label) >= {size} as is_cluster from mem0),
sz as (select grp, label, count(*) as s, row_number() over (partition by grp order by count(*), label) as rk from mem where is_cluster group by 1, 2),
fst as (select grp, max(case when rk = 1 then s end) s0, max(case when rk = 2 then s end) s1, max(case when rk = 3 then s end) s2, (select count(*) from mem m where m.grp = sz.grp) as total from sz group by 1),
qa as (select *, case when total - s0 + 1 <= 3 then greatest(0, 3 - (total - s0)) else 0 end as q0 from fst),
qb as (select *, case when total - s0 - s1 + q0 + 2 <= 3 then greatest(0, 2 - (total - s0 - s1 + q0)) else 0 end as q1 from qa),
qc as (select *, case when total - s0 - s1 - s2 + q0 + q1 + 3 <= 3 then greatest(0, 1 - (total - s0 - s1 - s2 + q0 + q1)) else 0 end as q2 from qb),
quota as (select sz.grp, label, case rk when 1 then q0 when 2 then q1 else q2 end as q from sz join qc using (grp) where rk <= 3),
rel as materialized (select m.*, coalesce(row_number() over (partition by m.grp, m.label order by distance desc, id desc) <= q, false) as released from mem m left join quota on quota.grp = m.grp and quota.label = m.label),
merged as materialized (select grp, label as terminal_id, count(*) as size, avg(x) as x from rel where is_cluster and not released group by 1, 2),
alone as (select *, row_number() over (partition by grp order by id) as rk from rel where not is_cluster or released),
free as (select grp, n, row_number() over (partition by grp order by n) as rk from
  (select a.grp, unnest(generate_series(0, a.c + coalesce(b.c, 0) - 1)) as n from (select grp, count(*) c from alone group by 1) a left join (select grp, count(*) c from merged group by 1) b using (grp)) s
  where not exists (select 1 from merged m where m.grp = s.grp and m.terminal_id = s.n))
"""


@shelf.add("c04_sphere_members", f"with recursive {members_sql(RADIUS, 4)} select grp, id, label, size, {r6s('distance')} as distance, is_cluster from mem")
def c04(spark, sf):
    cfg = C.ClusterConfig("sphere", sphere_radius=RADIUS, min_size=4)
    return C.sphere_members(cloud(spark, sf), ["grp"], cfg).select("grp", "id", "label", "size", r6(F.col("distance")).alias("distance"), "is_cluster")


@shelf.add("c05_released_members", f"with recursive {members_sql(WIDE, 4)} select grp, id, label, released from rel")
def c05(spark, sf):
    cfg = C.ClusterConfig("sphere", sphere_radius=WIDE, min_size=4)
    return C.release_farthest(C.sphere_members(cloud(spark, sf), ["grp"], cfg), ["grp"]).select("grp", "id", "label", "released")


_CLUSTERS = """select grp, terminal_id, size, round(x, 6) + 0.0 as x from merged
    union all select a.grp, n, 1, round(x, 6) + 0.0 from alone a join free f on f.grp = a.grp and f.rk = a.rk"""


@shelf.add("c06_sphere_clusters", f"with recursive {members_sql(RADIUS, 4)} {_CLUSTERS}")
def c06(spark, sf):
    table_, _ = C.sphere_clusters(cloud(spark, sf), ["grp"], C.ClusterConfig("sphere", sphere_radius=RADIUS, min_size=4))
    return table_.select("grp", "terminal_id", "size", r6(F.col("x")).alias("x"))


@shelf.add("c06_wide_sphere_clusters", f"with recursive {members_sql(WIDE, 4)} {_CLUSTERS}")
def c06_wide(spark, sf):
    table_, _ = C.sphere_clusters(cloud(spark, sf), ["grp"], C.ClusterConfig("sphere", sphere_radius=WIDE, min_size=4))
    return table_.select("grp", "terminal_id", "size", r6(F.col("x")).alias("x"))


@shelf.add("c01_basic_clusters", f"""with {POINTS_SQL}, leaves as (select p.* from points p where parent_id <> -1 and not exists
      (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id))
    select morphology, 1::bigint as terminal_id, count(*) as size, {r6s('avg(x)')} as x, {r6s('avg(z)')} as z from leaves group by 1""")
def c01(spark, sf):
    return C.basic(T.terminals(points(spark, sf)), [M]).select(M, "terminal_id", "size", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


PATH_SQL = f"""
{CLOSURE_SQL},
leaves as materialized (select p.morphology, p.point_id, p.x, p.y, p.z from points p where parent_id <> -1 and not exists
  (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id)),
prs as materialized (select a.morphology, a.point_id as a, b.point_id as b from leaves a join leaves b on a.morphology = b.morphology and a.point_id < b.point_id
  where sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 40),
legs as (select p.*, c.ancestor, c.steps from prs p join closure c on c.morphology = p.morphology and c.point_id = p.a
  union all select p.*, c.ancestor, c.steps from prs p join closure c on c.morphology = p.morphology and c.point_id = p.b),
seen as materialized (select morphology, a, b, ancestor, count(*) as n, min(steps) as s from legs group by 1, 2, 3, 4),
pth as materialized (select morphology, a, b, ancestor from seen where n = 1
  union all select morphology, a, b, arg_min(ancestor, s) from seen where n = 2 group by 1, 2, 3),
placed_at as materialized (select p.morphology, a, b, x, y, z from pth p join points q on q.morphology = p.morphology and q.point_id = p.ancestor),
close as materialized (select u.morphology, u.a, u.b from placed_at u join placed_at v on u.morphology = v.morphology and u.a = v.a and u.b = v.b
  group by 1, 2, 3 having max(sqrt((u.x-v.x)*(u.x-v.x) + (u.y-v.y)*(u.y-v.y) + (u.z-v.z)*(u.z-v.z))) <= 90),
sym as (select morphology, a, b from close union all select morphology, b, a from close),
reach as (select morphology, point_id as a, point_id as b from leaves union select r.morphology, r.a, s.b from reach r join sym s on s.morphology = r.morphology and s.a = r.b),
comp as materialized (select morphology, a as point_id, min(b) as cluster from reach group by 1, 2)
"""
PARENTS = C.ClusterConfig("sphere_parents", sphere_radius=40.0, max_path_distance=90.0)


def tree_nodes(spark, sf):
    pts = shared(spark, sf, "plain-points", lambda: points(spark, sf)).select(M, F.col("point_id").alias("id"), "parent_id", "x", "y", "z")
    parents = pts.select(M, F.col("parent_id").alias("id"))
    leaves = pts.filter("parent_id <> -1").join(parents, [M, "id"], "left_anti")
    ends = leaves.unionByName(pts.filter("parent_id = -1")).select(M, "id", "x", "y", "z", (F.col("parent_id") == -1).alias("is_root"))
    return pts, shared(spark, sf, "tree-ends", lambda: ends)


@shelf.add("c07_close_paths", f"with recursive {PATH_SQL} select morphology, a, b from close", together=True)
def c07(spark, sf):
    nodes, ends = tree_nodes(spark, sf)
    return C.close_paths(nodes, ends.filter("not is_root"), [M], PARENTS)


_PATH_CLUSTERS = f"""with recursive {PATH_SQL},
    sizes as (select morphology, cluster, count(*) as size, avg(x) as x from comp join leaves using (morphology, point_id) group by 1, 2)
    select morphology, row_number() over (partition by morphology order by size desc, cluster) as terminal_id, size, {r6s('x')} as x from sizes
    union all select morphology, 0, 1, {r6s('x')} from points where parent_id = -1"""


@shelf.add("c08_path_clusters", _PATH_CLUSTERS, together=True)
def c08(spark, sf):
    nodes, ends = tree_nodes(spark, sf)
    clusters, _ = C.sphere_parent_clusters(nodes, ends, [M], PARENTS)
    return clusters.select(M, "terminal_id", "size", r6(F.col("x")).alias("x"))


def _split_sql(r: int) -> str:
    """SQL of one split: the earliest part with several leaves goes apart below its lowest ancestor."""
    return f"""
cnt{r} as materialized (select morphology, part, count(*) as n from p{r} group by 1, 2),
pick{r} as materialized (select morphology, min(part) filter (where n > 1) as part from cnt{r} group by 1
  having count(*) + 1 < 4 and count(*) filter (where n > 1) > 0),
ins{r} as materialized (select q.*, n from p{r} q join pick{r} using (morphology, part) join cnt{r} using (morphology, part)),
top{r} as (select morphology, arg_min(ancestor, s) as ancestor from (
  select i.morphology, c.ancestor, min(c.steps) as s from ins{r} i join closure c using (morphology, point_id)
  group by 1, 2 having count(*) = min(n)) group by 1),
way{r} as (select i.morphology, i.point_id, c.steps from ins{r} i join top{r} t using (morphology)
  join closure c on c.morphology = i.morphology and c.point_id = i.point_id and c.ancestor = t.ancestor),
child{r} as (select w.morphology, w.point_id, coalesce(c.ancestor, w.point_id) as child from way{r} w
  left join closure c on c.morphology = w.morphology and c.point_id = w.point_id and c.steps = w.steps - 1),
p{r + 1} as materialized (select q.morphology, q.point_id, coalesce(child, part) as part
  from p{r} q left join child{r} using (morphology, point_id))"""


SPLIT_SQL = f"""
{CLOSURE_SQL},
leaves as materialized (select p.morphology, p.point_id, p.x, p.y, p.z from points p where parent_id <> -1 and not exists
  (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id)),
p0 as materialized (select morphology, point_id, 0 as part from leaves),
""" + ",".join(_split_sql(r) for r in range(3))


@shelf.add("c09_split_clusters", f"""with recursive {SPLIT_SQL},
    sizes as (select morphology, part, count(*) as size, min(point_id) as first, avg(x) as x from p3 join leaves using (morphology, point_id) group by 1, 2)
    select morphology, row_number() over (partition by morphology order by first) as terminal_id, size, {r6s('x')} as x from sizes
    union all select morphology, 0, 1, {r6s('x')} from points where parent_id = -1""", together=True)
def c09(spark, sf):
    """Every tree starts as one cluster here, so all of them are split until four exist."""
    nodes, ends = tree_nodes(spark, sf)
    cfg = C.ClusterConfig("sphere_parents", sphere_radius=200.0)
    clusters, _ = C.sphere_parent_clusters(nodes, ends, [M], cfg)
    return clusters.select(M, "terminal_id", "size", r6(F.col("x")).alias("x"))


_REGION_CLUSTERS = f"""with recursive {CUT_SQL},
    ends as (select p.morphology, p.point_id as segment_id, case when q.parent_id = -1 then -1 else p.parent_id end as source
      from points p join points q on q.morphology = p.morphology and q.point_id = p.parent_id),
    raw_edges as (select r.morphology, coalesce(b.new_id, e.source) as source, coalesce(a.new_id, r.segment_id) as target, r.region_id
      from runs r join ends e using (morphology, segment_id)
      left join fresh a on a.morphology = r.morphology and a.segment_id = r.segment_id and a.run = r.run
      left join fresh b on b.morphology = r.morphology and b.segment_id = r.segment_id and b.run = r.run - 1),
    edge as materialized (select morphology, source, target, case when region_id >= 100 and n_regionkey < 2 then 10 + n_regionkey else region_id end as region_id
      from raw_edges left join nation on region_id = 100 + n_nationkey),
    tops as (select e.morphology, e.region_id, e.target as node, e.source as top from edge e
        where not exists (select 1 from edge u where u.morphology = e.morphology and u.target = e.source and u.region_id = e.region_id)
      union all select e.morphology, e.region_id, e.target, t.top from edge e join tops t on t.morphology = e.morphology and t.node = e.source and t.region_id = e.region_id),
    topped as materialized (select * from tops),
    comp as (select morphology, region_id, top, least(min(node), top) as component from topped group by 1, 2, 3),
    leaf as (select t.*, c.component from topped t join comp c using (morphology, region_id, top) join points p on p.morphology = t.morphology and p.point_id = t.node
      where not exists (select 1 from points k where k.morphology = t.morphology and k.parent_id = t.node)),
    used as (select morphology, region_id, component, row_number() over (partition by morphology order by region_id, component) - 1 as terminal_id from (select distinct morphology, region_id, component from leaf))
    select l.morphology, u.terminal_id, count(*) as size, {r6s('avg(p.x)')} as x from leaf l join used u on u.morphology = l.morphology and u.region_id = l.region_id and u.component = l.component
      join points p on p.morphology = l.morphology and p.point_id = l.node group by 1, 2"""


@shelf.add("c10_region_clusters", _REGION_CLUSTERS)
def c10(spark, sf):
    _tree, ends = tree_nodes(spark, sf)
    clusters, _ = C.region_clusters(nested_edges(spark, sf), ends.filter("not is_root").select(M, "id", "x", "y", "z"), [M])
    return clusters.select(M, "terminal_id", "size", r6(F.col("x")).alias("x"))


def nested_edges(spark, sf):
    """Edges cut at region borders, with the first of a region's elders that is known."""
    _nodes, edges = _cut(spark, sf)
    known = (
        table(spark, sf, "region").select((10 + F.col("r_regionkey")).cast("bigint").alias("id"))
        .unionByName(table(spark, sf, "nation").filter("n_regionkey >= 2").select((100 + F.col("n_nationkey")).cast("bigint").alias("id"))))
    nested = R.first_nested(edges.select(F.col("region_id").alias("id")).distinct(), known, elders(spark, sf))
    joined = edges.join(nested.select(F.col("id").alias("region_id"), "nested_id"), "region_id").drop("region_id").withColumnRenamed("nested_id", "region_id")
    return shared(spark, sf, "nested-edges", lambda: joined)


# every user's tree, and the trees of single event types that have fewer than five points
CLUSTERINGS = {
    "near": C.ClusterConfig("sphere", sphere_radius=25.0, min_size=3), "paths": PARENTS,
    "regions": C.ClusterConfig("brain_regions"), "whole": C.ClusterConfig("basic"),
}
_LEAVES = """leaves as materialized (select p.morphology, p.point_id, p.x, p.y, p.z from points p where parent_id <> -1 and not exists
  (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id))"""
_LEAF_CLOUD = f"""{POINTS_SQL.replace("points as (", "points as materialized (")}, {_LEAVES},
cloud as materialized (select point_id as id, morphology as grp, x, y, z from leaves)"""
_NEAR = members_sql(25.0, 3).replace(CLOUD_SQL.replace("cloud as (", "cloud as materialized ("), _LEAF_CLOUD)


@shelf.add("c11_cluster_methods", f"""
    select 'near' as config_name, grp as morphology, 'sphere' as method, terminal_id, size, x from (with recursive {_NEAR} {_CLUSTERS})
    union all select 'paths', morphology, 'sphere_parents', terminal_id, size, x from ({_PATH_CLUSTERS})
    union all select 'regions', morphology, 'brain_regions', terminal_id, size, x from ({_REGION_CLUSTERS})
    union all select 'whole', morphology, 'basic', 1, count(*), {r6s('avg(x)')} from (with {POINTS_SQL}, {_LEAVES} select * from leaves) group by 2
    union all select config_name, morphology, 'basic', 1, count(*), {r6s('avg(x)')} from (with {FOREST_SQL},
        small as (select morphology, neurite from forest group by 1, 2 having count(*) < 5)
        select f.morphology || '|' || f.neurite as morphology, f.x from forest f join small using (morphology, neurite) where f.parent_id <> -1
          and not exists (select 1 from forest c where c.morphology = f.morphology and c.neurite = f.neurite and c.parent_id = f.point_id))
      cross join (values {", ".join(f"('{name}')" for name in CLUSTERINGS)}) t(config_name) group by 1, 2""")
def c11(spark, sf):
    """Four clusterings of every user's tree and, as further axons, of the neurites that are too
    small for any but the basic one."""
    nodes, ends = tree_nodes(spark, sf)
    few = forest(spark, sf).join(
        forest(spark, sf).groupBy(M, "neurite").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < C.MIN_AXON_POINTS), [M, "neurite"], "left_semi"
    ).withColumn(M, F.concat(M, F.lit("|"), "neurite"))
    few = written(few.select(M, F.col("point_id").alias("id"), "parent_id", "x", "y", "z"), "small-axons")
    tips = few.join(few.select(M, F.col("parent_id").alias("id")), [M, "id"], "left_anti").filter("parent_id <> -1")
    tips = tips.unionByName(few.filter("parent_id = -1")).select(M, "id", "x", "y", "z", (F.col("parent_id") == -1).alias("is_root"))
    clusters, _ = C.cluster_axons(
        nodes.unionByName(few.select(*nodes.columns)), ends.unionByName(tips), [M], CLUSTERINGS,
        region_edges=nested_edges(spark, sf),
    )
    return clusters.select("config_name", M, "method", "terminal_id", "size", r6(F.col("x")).alias("x"))


_METHOD_NAMES = ["sphere", "sphere_parents", "brain_regions", "basic", "spheres"]


@shelf.add("c17_cluster_parameters", f"""with given as (select p_name || '|' || p_size % 3 as name, {_METHOD_NAMES}[p_partkey % 5 + 1] as method,
        case when p_partkey % 3 > 0 then (p_size - 5)::double end as sphere_radius, case when p_partkey % 4 > 0 then p_size % 7 end as min_size,
        case when p_partkey % 2 > 0 then (p_size - 10)::double end as max_path_distance from part),
    filled as (select name, method, case when method in ('sphere', 'sphere_parents') then coalesce(sphere_radius, 100.0::double) end as sphere_radius,
        case when method = 'sphere' then coalesce(min_size, 10) end as min_size, max_path_distance as given_path, count(*) over (partition by name) as n from given),
    whole as (select * exclude given_path, case when method = 'sphere_parents' then coalesce(given_path, sphere_radius) end as max_path_distance from filled)
    select name, method, sphere_radius, min_size, max_path_distance, case when method = 'brain_regions' then true end as wm_unnesting,
      case when n > 1 then 'name given twice' when method = 'spheres' then 'unknown method' when sphere_radius <= 0 then 'sphere_radius must be positive'
        when min_size < 1 then 'min_size must be at least 1' when max_path_distance <= 0 then 'max_path_distance must be positive' end as problem from whole""")
def c17(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    given = table(spark, sf, "part").select(
        F.concat("p_name", F.lit("|"), (size % 3).cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(m) for m in _METHOD_NAMES]), (key % 5 + 1).cast("int")).alias("method"),
        F.when(key % 3 > 0, (size - 5).cast("double")).alias("sphere_radius"),
        F.when(key % 4 > 0, (size % 7).cast("int")).alias("min_size"),
        F.when(key % 2 > 0, (size - 10).cast("double")).alias("max_path_distance"),
    )
    return C.checked_configs(given)


_D1 = "case when lag(f) over w is null then lead(f) over w - f when lead(f) over w is null then f - lag(f) over w else (lead(f) over w - lag(f) over w) / 2 end"
_D2 = _D1.replace("(f)", "(d1)").replace("- f ", "- d1 ").replace("then f ", "then d1 ")


@shelf.add("c12_density_minima", f"""with st as (select event_type, min(value) lo, max(value) hi, count(*) n, var_samp(value) v from events group by 1),
    sp as (select *, (hi - lo) / 100.0::double as width, v * pow(n::double, -0.4) as spread from st),
    g as (select event_type, unnest(generate_series(0, 99)) as bin, lo, width, spread, n from sp),
    dens as materialized (select g.event_type, bin, any_value(lo + (bin + 0.5) * width) as position, sum(exp(-(lo + (bin + 0.5) * width - value) * (lo + (bin + 0.5) * width - value) / (2.0 * spread))) / (any_value(n) * sqrt(6.283185307179586 * any_value(spread))) as f
      from g join events e on e.event_type = g.event_type group by 1, 2),
    a as (select *, {_D1} as d1 from dens window w as (partition by event_type order by bin)),
    b as materialized (select *, {_D2} as d2 from a window w as (partition by event_type order by bin)),
    c as materialized (select *, abs(d1) / max(abs(d1)) over (partition by event_type) as ratio,
        coalesce(lead(sign(d1)) over w <> sign(d1), false)::integer as f1, coalesce(lead(sign(d2)) over w <> sign(d2), false)::integer as f2 from b window w as (partition by event_type order by bin)),
    d as materialized (select *, sum(f1) over w as p1, sum(f2) over w as p2, min(case when d2 > 0 then ratio end) over (partition by event_type) as lst from c window w as (partition by event_type order by bin)),
    low as (select * from d where d2 > 0 and ratio < 0.1 * pow(2, case when lst < 0.1 then 0 else floor(log2(lst / 0.1)) + 1 end)),
    m1 as (select event_type, unnest(list(bin order by bin)[(count(*) // 2 + 1)::integer : (count(*) // 2 + 1)::integer]) as bin from low group by event_type, p1),
    m2 as (select event_type, unnest(list(bin order by bin)[(count(*) // 2 + 1)::integer : (count(*) // 2 + 1)::integer]) as bin from m1 join d using (event_type, bin) group by event_type, p2)
    select event_type, bin::integer as bin, {r6s('position')} as position from m2 join dens using (event_type, bin)""")
def c12(spark, sf):
    return C.density_minima(table(spark, sf, "events"), ["event_type"], value="value").withColumn("position", r6(F.col("position")))


KINDS = ["click", "error", "purchase", "signup", "view"]


TUFT_SQL = f"""
{SECTIONS_SQL}, {VOXELS_SQL},
    leafs as materialized (select s.morphology, s.section_id, s.x_last, s.y_last, s.z_last, list_position(['click', 'error', 'purchase', 'signup', 'view'], p.event_type) as tuft_id
      from sections s join points p on p.morphology = s.morphology and p.point_id = s.last_point where s.n_children = 0),
    sz as materialized (select morphology, tuft_id, count(*) as size, avg(x_last) as cx, avg(y_last) as cy, avg(z_last) as cz from leafs group by 1, 2),
    sh as materialized (select l.morphology, l.tuft_id, u.ancestor, min(u.steps) as s, sz.size from leafs l join up u using (morphology, section_id) join sz using (morphology, tuft_id)
      group by l.morphology, l.tuft_id, u.ancestor, sz.size having count(*) = sz.size),
    pick as (select morphology, tuft_id, ancestor, size, row_number() over (partition by morphology, tuft_id order by s) as r, count(*) over (partition by morphology, tuft_id) as n from sh),
    anc as (select morphology, tuft_id, size, ancestor as section_id from pick where r = case when size = 1 and n + 1 > 2 then 2 else 1 end),
    pd as materialized (select u.morphology, u.section_id, sum(a.length) as path_distance from up u join sections a on a.morphology = u.morphology and a.section_id = u.ancestor group by all),
    below as (select u.morphology, u.ancestor as section_id, sum(s.length) as path_length, max(pd.path_distance) as max_path_extent
      from up u join sections s using (morphology, section_id) join pd using (morphology, section_id) group by all),
    props as materialized (select a.morphology, a.tuft_id::bigint as tuft_id, a.size, a.section_id as ca, s.x_last as ax, s.y_last as ay, s.z_last as az, cx,
      (cx - s.x_last) / nullif(sqrt((cx-s.x_last)*(cx-s.x_last) + (cy-s.y_last)*(cy-s.y_last) + (cz-s.z_last)*(cz-s.z_last)), 0) as u0,
      (cy - s.y_last) / nullif(sqrt((cx-s.x_last)*(cx-s.x_last) + (cy-s.y_last)*(cy-s.y_last) + (cz-s.z_last)*(cz-s.z_last)), 0) as v0,
      path_distance, path_length, max_path_extent
      from anc a join sections s using (morphology, section_id) join sz using (morphology, tuft_id) join pd using (morphology, section_id) join below using (morphology, section_id)),
    mp as materialized (select l.morphology, l.tuft_id, u.ancestor as section_id, max(1 + pl.path_distance - pc.path_distance) as top
      from leafs l join up u on u.morphology = l.morphology and u.section_id = l.section_id join props p on p.morphology = l.morphology and p.tuft_id = l.tuft_id
      join up uc on uc.morphology = l.morphology and uc.section_id = l.section_id and uc.ancestor = p.ca
      join pd pl on pl.morphology = l.morphology and pl.section_id = l.section_id join pd pc on pc.morphology = l.morphology and pc.section_id = p.ca
      where u.steps <= uc.steps group by 1, 2, 3),
    rk as (select m.*, s.parent_section_id, p.ca, row_number() over (partition by m.morphology, m.tuft_id, s.parent_section_id order by top desc, m.section_id) as r
      from mp m join sections s on s.morphology = m.morphology and s.section_id = m.section_id join props p on p.morphology = m.morphology and p.tuft_id = m.tuft_id),
    bars as materialized (select k.morphology, k.tuft_id::bigint as tuft_id, k.section_id, k.top as birth, case when k.section_id = ca then 0 else 1 + pp.path_distance - pc.path_distance end as death
      from rk k join pd pc on pc.morphology = k.morphology and pc.section_id = k.ca left join pd pp on pp.morphology = k.morphology and pp.section_id = k.parent_section_id
      where k.section_id = ca or r > 1)
"""


def tuft_tables(spark, sf):
    """Properties and bars of the tufts: the leaves of a tree by the event type of their point."""
    made = {}

    def both():
        if not made:
            sections = section_table(spark, sf)
            kinds = points(spark, sf).select(M, F.col("point_id").alias("last_point"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).alias("tuft_id"))
            leaves = written(sections.filter("is_leaf").join(kinds, [M, "last_point"]), "leaves")
            clusters = leaves.groupBy(M, F.col("tuft_id").alias("terminal_id")).agg(F.count(F.lit(1)).alias("size"), *[F.avg(f"{a}_last").alias(a) for a in "xyz"])
            into = table(spark, sf, "supplier").select(
                (100 + F.col("s_nationkey")).cast("bigint").alias("region_id"), F.col("s_suppkey").cast("bigint").alias("order"),
                F.col("s_name").alias("target_projection_name"), F.col("s_suppkey").cast("double").alias("pop_neuron_numbers"),
                (F.lit(1000.0) + F.col("s_suppkey") % 7).alias("volume"),
                F.when(F.col("s_suppkey") % 3 != 0, F.lit(0.5)).alias("fraction"), F.lit(2.0).alias("strength"),
            )
            made["all"] = TU.complete_properties(
                sections, leaves.select(M, "section_id", "tuft_id"), clusters, written(T.section_measures(sections), "measures"), [M],
                voxels=voxels(spark, sf), field=rotation_field(spark, sf), projections=into, grid=GRID, bouton_density=0.2,
            )
        return made["all"]

    return shared(spark, sf, "tuft-table", lambda: both()[0]), shared(spark, sf, "tuft-bars", lambda: both()[1])


@shelf.add("c13_cluster_properties", f"""with recursive {TUFT_SQL},
    reg as materialized (select p.*, coalesce(v.region_id, 0) as region_id, {u_sql("p.morphology", "p.tuft_id", "'projection'")} as u from props p
      left join voxels v on v.i = {idx_sql("ax")} and v.j = {idx_sql("ay")} and v.k = {idx_sql("az")}),
    into_region as (select 100 + s_nationkey as region_id, s_suppkey, s_name, row_number() over (partition by s_nationkey order by s_suppkey) as rn, count(*) over (partition by s_nationkey) as n from supplier),
    drawn as (select r.morphology, r.tuft_id, s_name, s_suppkey from reg r join into_region i on i.region_id = r.region_id and u >= (rn - 1)::double / n and u < case when rn = n then 1.0::double else rn::double / n end),
    summed as (select morphology, tuft_id, count(*) as n_bars, sum(birth) as births, sum(death) as deaths from bars group by 1, 2)
    select r.morphology, r.tuft_id, size, ca as common_ancestor_id, {r6s('ax')} as common_ancestor_x, {r6s('cx')} as center_x,
      {r6s('case when region_id = 0 then u0 else cos(radians(region_id)) * u0 - sin(radians(region_id)) * v0 end')} as ux,
      {r6s('case when region_id = 0 then v0 else sin(radians(region_id)) * u0 + cos(radians(region_id)) * v0 end')} as uy,
      {r6s('path_distance')} as path_distance, {r6s('path_length')} as path_length, {r6s('max_path_extent')} as max_path_extent, region_id, coalesce(s_name, 'default') as target_projection_name,
      {r6s("case when s_suppkey % 3 <> 0 then (1000.0::double + s_suppkey % 7) * 2.0 / (s_suppkey * 0.5::double) / 0.2::double end", 4)} as mean_tuft_length,
      n_bars, {r6s('births', 4)} as sum_of_births, {r6s('deaths', 4)} as sum_of_deaths
    from reg r left join drawn d on d.morphology = r.morphology and d.tuft_id = r.tuft_id left join summed s on s.morphology = r.morphology and s.tuft_id = r.tuft_id""")
def c13(spark, sf):
    out = tuft_tables(spark, sf)[0]
    names = ["common_ancestor_x", "center_x", "ux", "uy", "path_distance", "path_length", "max_path_extent"]
    wide = ["mean_tuft_length", "sum_of_births", "sum_of_deaths"]
    return out.select(
        M, "tuft_id", "size", "common_ancestor_id", *[r6(F.col(n)).alias(n) for n in names], "region_id",
        "target_projection_name", "n_bars", *[r6(F.col(n), 4).alias(n) for n in wide],
    )


@shelf.add("c13_tuft_barcodes", f"with recursive {TUFT_SQL} select morphology, tuft_id, section_id, {r6s('birth')} as birth, {r6s('death')} as death from bars")
def c13_bars(spark, sf):
    bars = tuft_tables(spark, sf)[1]
    return bars.select(M, "tuft_id", "section_id", r6(F.col("birth")).alias("birth"), r6(F.col("death")).alias("death"))


@shelf.add("c14_mean_tuft_lengths", f"""select p_partkey, {r6s('case when p_size <> 10 and p_partkey % 9 <> 0 then p_retailprice * 2.5 / (p_size * (p_partkey % 9)) / 0.2 end')} as mean_tuft_length from part""")
def c14(spark, sf):
    part = table(spark, sf, "part")
    n_pot = F.when(F.col("p_size") != 10, F.col("p_size"))
    return part.select("p_partkey", r6(C.mean_tuft_length(F.col("p_retailprice"), n_pot, F.col("p_partkey") % 9, F.lit(2.5), F.lit(0.2))).alias("mean_tuft_length"))


@shelf.add("c15_assembled_terminals", f"""with {FOREST_SQL}, big as (select morphology, neurite, count(*) as size from forest group by 1, 2)
    select morphology, neurite, 1::bigint as terminal_id, case when size >= 5 then size else 1 end as size, case when size >= 5 then 'sphere' else 'basic' end as config_name from big""")
def c15(spark, sf):
    counts = forest(spark, sf).groupBy(M, "neurite").agg(F.count(F.lit(1)).alias("size")).withColumn("terminal_id", F.lit(1).cast("bigint"))
    one = counts.filter("size >= 5").withColumn("config_name", F.lit("sphere"))
    two = counts.filter("size < 5").withColumn("config_name", F.lit("basic")).drop("size")
    return C.assemble_terminals([one, two], [M, "neurite"]).select(M, "neurite", "terminal_id", "size", "config_name")


@shelf.add("c16_names_from_paths", r"select page_id, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) as morphology from pages")
def c16(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.morphology_name(F.col("url")).alias(M))


# every event's point against the whole cloud, which is moved to where the points lie
_MOVED = {a: f"50 + 40 * {a}" for a in "xyz"}


@shelf.add("g15_nearest_distance", f"""with {POINTS_SQL.replace("points as (", "points as materialized (")}, {CLOUD_SQL},
    b as materialized (select {", ".join(f"{e} as {a}" for a, e in _MOVED.items())} from cloud)
    select a.event_id as id, {r6s('min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))')} as distance from points a, b group by 1""")
def g15(spark, sf):
    pts = written(points(spark, sf).select(F.col("event_id").alias("id"), "x", "y", "z"), "cloud")
    targets = cloud(spark, sf).select("id", *[(50 + 40 * F.col(a)).alias(a) for a in "xyz"])
    return nearest_distance(pts, targets).withColumn("distance", r6(F.col("distance")))
