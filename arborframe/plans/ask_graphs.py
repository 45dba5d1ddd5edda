"""Queries on candidate graphs.

The source is the first point of a user's tree, its targets are all further points of the user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators import graph as G
from arborframe.plans.ask_voxels import GRID, HEIGHTS_SQL, depths, idx_sql
from arborframe.plans.registry import Shelf
from arborframe.plans.views import POINTS_SQL, VOXELS_SQL, points, r6, r6s, shared, u_sql, voxels
from arborframe.operators import voxels as V

shelf = Shelf()
M = "morphology"

START_SQL = f"""
{POINTS_SQL.replace("points as (", "points as materialized (")},
srcs as (select morphology, x as sx, y as sy, z as sz from points where point_id = 1),
targets as materialized (select p.*, sx, sy, sz, sqrt((x-sx)*(x-sx) + (y-sy)*(y-sy) + (z-sz)*(z-sz)) as d from points p join srcs using (morphology) where point_id > 1),
counted as (select *, least(floor(d / 30), 3)::integer as n from targets),
steps as (select *, unnest(generate_series(1, n)) as step from counted where n > 0),
inter as materialized (select morphology, point_id, step, sx + (x - sx) * (step / (n + 1)::double) as x, sy + (y - sy) * (step / (n + 1)::double) as y, sz + (z - sz) * (step / (n + 1)::double) as z from steps),
allp as (select morphology, sx as x, sy as y, sz as z from srcs union all select morphology, x, y, z from targets union all select morphology, x, y, z from inter),
bb as (select morphology, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 from allp group by 1),
corners0 as (select *, unnest(generate_series(0, 7)) as corner from bb),
corners as (select morphology, min(corner)::integer as corner, x, y, z from (select morphology, corner, case when corner & 1 = 1 then x1 else x0 end as x, case when corner & 2 = 2 then y1 else y0 end as y, case when corner & 4 = 4 then z1 else z0 end as z from corners0) group by morphology, x, y, z),
parts as (select morphology, 0 as rk, 1 as ord, sx as x, sy as y, sz as z, 'source' as provider, -1 as terminal_id from srcs
  union all select morphology, 1, point_id, x, y, z, 'target', point_id from targets
  union all select morphology, 2, point_id * 10 + step, x, y, z, 'intermediate', -1 from inter
  union all select morphology, 5, corner, x, y, z, 'bbox', -1 from corners c
    where not exists (select 1 from allp a where a.morphology = c.morphology and a.x = c.x and a.y = c.y and a.z = c.z)),
nodes as materialized (select morphology, row_number() over (partition by morphology order by rk, ord) - 1 as id, x, y, z, provider, rk < 2 as is_terminal, terminal_id::bigint as terminal_id from parts)
"""


def start(spark, sf):
    pts = shared(spark, sf, "plain-points", lambda: points(spark, sf)).select(M, "point_id", "event_type", "x", "y", "z")
    src = pts.filter("point_id = 1").select(M, *[F.col(a).alias(f"source_{a}") for a in "xyz"])
    targets = pts.filter("point_id > 1").join(src, M)
    return pts, src, targets.withColumnRenamed("point_id", "id")


def inter(spark, sf):
    _, _, targets = start(spark, sf)
    return G.intermediate_points(targets, [M], min_distance=30.0, most=3)


@shelf.add("g01_intermediate_points", f"with {START_SQL} select morphology, point_id as id, step::integer as step, {r6s('x')} as x, {r6s('y')} as y, {r6s('z')} as z from inter")
def g01(spark, sf):
    return inter(spark, sf).select(M, "id", "step", *[r6(F.col(a)).alias(a) for a in "xyz"])


def parts(spark, sf, new_corners_only=True):
    _, src, targets = start(spark, sf)
    own = src.select(M, F.lit(1).alias("order"), *[F.col(f"source_{a}").alias(a) for a in "xyz"])
    goal = targets.select(M, F.col("id").alias("order"), "x", "y", "z", F.col("id").alias("terminal_id"))
    mid0 = G.intermediate_points(targets, [M], min_distance=30.0, most=3).select(M, (F.col("id") * 10 + F.col("step")).alias("order"), "x", "y", "z")
    mid = shared(spark, sf, "graph-intermediate", lambda: mid0)
    every = own.select(M, "x", "y", "z").unionByName(goal.select(M, "x", "y", "z")).unionByName(mid.select(M, "x", "y", "z"))
    corners = G.box_corners(every, [M])
    if new_corners_only:
        corners = corners.join(every, [M, "x", "y", "z"], "left_anti")
    return {"source": own, "target": goal, "intermediate": mid, "bbox": corners.withColumnRenamed("corner", "order")}


@shelf.add("g02_box_corners", f"with {START_SQL} select morphology, corner, {r6s('x')} as x, {r6s('y')} as y, {r6s('z')} as z from corners")
def g02(spark, sf):
    return parts(spark, sf, new_corners_only=False)["bbox"].select(M, F.col("order").alias("corner"), *[r6(F.col(a)).alias(a) for a in "xyz"])


def walk_sql(limit: float, points: str = "ordered", unit: str = "morphology") -> str:
    """SQL of the thinning: points by rank ``rn`` of a unit, each kept when no kept one is near."""
    far = f"len(list_filter(held, lambda h: sqrt((h.x - o.x) * (h.x - o.x) + (h.y - o.y) * (h.y - o.y) + (h.z - o.z) * (h.z - o.z)) <= {limit})) = 0"
    spot = "{'x': o.x, 'y': o.y, 'z': o.z}"
    return f"""walk as (
  select {unit}, rn, true as kept, [{spot}] as held from {points} o where rn = 1
  union all
  select o.{unit}, o.rn, {far}, case when {far} then list_append(held, {spot}) else held end
  from walk w join {points} o on o.{unit} = w.{unit} and o.rn = w.rn + 1)"""


_DRAWN = ", ".join(
    f"""{a}0 - 5.0 + {u_sql("morphology", "draw", f"'random_{a}'")} * ({a}1 + 5.0 - ({a}0 - 5.0)) as {a}"""
    for a in "xyz"
)


@shelf.add("g03_random_points", f"""with recursive {POINTS_SQL.replace("points as (", "points as materialized (")},
    box as (select morphology, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 from points group by 1),
    drawn as materialized (select morphology, draw, {_DRAWN} from (select *, unnest(range(0, 40)) as draw from box)),
    ordered as materialized (select *, row_number() over (partition by morphology order by draw) as rn from drawn d
      where not exists (select 1 from points p where p.morphology = d.morphology and sqrt((p.x-d.x)*(p.x-d.x) + (p.y-d.y)*(p.y-d.y) + (p.z-d.z)*(p.z-d.z)) <= 15.0)),
    {walk_sql(15.0)}
    select morphology, draw, {r6s('x')} as x, {r6s('y')} as y, {r6s('z')} as z from walk join ordered using (morphology, rn) where kept""")
def g03(spark, sf):
    pts, _, _ = start(spark, sf)
    out = G.random_points(pts.select(M, "x", "y", "z"), [M], min_distance=15.0, candidates=40, buffer=5.0)
    return out.select(M, "draw", *[r6(F.col(a)).alias(a) for a in "xyz"])


def preferred(spark, sf):
    flat = (F.col("i") * GRID.shape[1] + F.col("j")) * GRID.shape[2] + F.col("k")
    return voxels(spark, sf).filter("region_id between 10 and 14").select(flat.cast("bigint").alias("id"), *V.centres(GRID))


PREF_SQL = f"pref as materialized (select (i * {GRID.shape[1]} + j) * {GRID.shape[2]} + k as id, (i + 0.5) * 10.0 - 20.0 as x, (j + 0.5) * 10.0 - 20.0 as y, (k + 0.5) * 10.0 - 20.0 as z from voxels where region_id between 10 and 14)"


@shelf.add("g04_attractor_points", f"""with recursive {VOXELS_SQL}, {PREF_SQL},
    ordered as materialized (select *, 1 as unit, row_number() over (order by u, id) as rn from (select *, {u_sql("id", "'attractor'")} as u from pref)),
    {walk_sql(25.0, unit="unit")}
    select id::bigint as id, x::double as x, y::double as y, z::double as z from walk join ordered using (rn) where kept""")
def g04(spark, sf):
    return G.attractor_points(preferred(spark, sf), min_distance=25.0)


@shelf.add("g04_barycentre_point", f"""with {VOXELS_SQL}, {PREF_SQL}, m as (select avg(x) mx, avg(y) my, avg(z) mz from pref)
    select id::bigint as id, x::double as x, y::double as y, z::double as z from pref, m order by (x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), id limit 1""")
def g04_bary(spark, sf):
    return G.barycentre_point(preferred(spark, sf))


@shelf.add("g05_points_inside", f"""with {START_SQL}, rb as (select morphology, min(x) - 0.1 * (max(x) - min(x)) x0, max(x) + 0.1 * (max(x) - min(x)) x1, min(y) - 0.1 * (max(y) - min(y)) y0, max(y) + 0.1 * (max(y) - min(y)) y1,
      min(z) - 0.1 * (max(z) - min(z)) z0, max(z) + 0.1 * (max(z) - min(z)) z1 from targets group by 1)
    select p.morphology, p.point_id from points p join rb using (morphology) where x between x0 and x1 and y between y0 and y1 and z between z0 and z1""")
def g05(spark, sf):
    pts, _, targets = start(spark, sf)
    return G.inside_reference(pts, targets, [M]).select(M, "point_id")


@shelf.add("g06_thinned_points", f"""with recursive {START_SQL},
    ordered as materialized (select *, row_number() over (partition by morphology order by not is_terminal, u, id) as rn
      from (select *, {u_sql("morphology", "id", "'thin'")} as u from nodes)),
    {walk_sql(8.0)}
    select morphology, id, is_terminal from walk join ordered using (morphology, rn) where kept""")
def g06(spark, sf):
    """Terminals first, then hashed order."""
    out = G.thin_close(nodes(spark, sf), [M], 8.0)
    return out.select(M, "id", "is_terminal")


def nodes(spark, sf):
    return shared(spark, sf, "graph-nodes", lambda: G.node_table(parts(spark, sf), [M]))


@shelf.add("g07_node_table", f"with {START_SQL} select morphology, id, provider, is_terminal, terminal_id, {r6s('x')} as x from nodes")
def g07(spark, sf):
    return nodes(spark, sf).select(M, "id", "provider", "is_terminal", "terminal_id", r6(F.col("x")).alias("x"))


@shelf.add("g07_filled_graphs", f"""with {START_SQL},
    small as (select morphology || '/' || (terminal_id // 8) as morphology, point_id as o, x, y, z, sx from (select *, point_id as terminal_id from targets)),
    few as materialized (select morphology, row_number() over (partition by morphology order by rk, o) - 1 as id, rk, x, sx
      from (select distinct morphology, 0 as rk, 1 as o, sx as x, sx from small union all select morphology, 1, o, x, sx from small)),
    spot as (select f.morphology, f.id, f.rk, f.x, f.sx, s.y, s.z, q.sy, q.sz from few f left join small s on s.morphology = f.morphology and f.rk = 1 and s.x = f.x
      join srcs q on q.morphology = split_part(f.morphology, '/', 1)),
    cn as (select morphology, count(*) as n from few group by 1),
    away as (select distinct morphology, id from spot where rk = 1 and not (x = sx and y = sy and z = sz)),
    fills as (select f.morphology, f.id, n, unnest(generate_series(1, 5 - n)) as step, f.x, f.sx from few f join cn using (morphology) join away using (morphology, id) where n < 5),
    allf as (select morphology, id as o, x from few union all select morphology, n + id * 5 + step, sx + (x - sx) * (step / (5 - n + 1)::double) from fills)
    select morphology, row_number() over (partition by morphology order by o) - 1 as id, {r6s('x')} as x from allf""")
def g07_fill(spark, sf):
    """Small graphs of all targets: a source with those of its targets that share eight ids."""
    _, src, targets = start(spark, sf)
    unit = F.concat(F.col(M), F.lit("/"), F.floor(F.col("id") / 8).cast("string"))
    goal = targets.select(
        unit.alias(M), F.col("id").alias("order"), "x", "y", "z", F.col("id").alias("terminal_id"),
        *[f"source_{a}" for a in "xyz"],
    )
    own = goal.select(M, F.lit(1).alias("order"), *[F.col(f"source_{a}").alias(a) for a in "xyz"]).distinct()
    graphs = G.node_table({"source": own, "target": goal}, [M])
    return G.fill_small_graphs(graphs, [M]).select(M, "id", r6(F.col("x")).alias("x"))


EDGE_SQL = f"""
{START_SQL},
knn as (select a.morphology, a.id as a, b.id as b, row_number() over (partition by a.morphology, a.id order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.id) as r
  from nodes a join nodes b on a.morphology = b.morphology and a.id <> b.id),
edges as materialized (select e.morphology, e.f, e.t, p.x as xf, p.y as yf, p.z as zf, q.x as xt, q.y as yt, q.z as zt,
    sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) as length
  from (select distinct morphology, least(a, b) as f, greatest(a, b) as t from knn where r <= 4) e
  join nodes p on p.morphology = e.morphology and p.id = e.f join nodes q on q.morphology = e.morphology and q.id = e.t)
"""


def edges(spark, sf):
    n = nodes(spark, sf)
    return n, shared(spark, sf, "graph-edges", lambda: G.nearest_edges(n, [M], k=4))


@shelf.add("g08_candidate_edges", f"""with {EDGE_SQL} select morphology, f as "from", t as "to", {r6s('length')} as length from edges""")
def g08(spark, sf):
    return edges(spark, sf)[1].select(M, "from", "to", r6(F.col("length")).alias("length"))


DIR_SQL = f"""
{EDGE_SQL},
dv as (select e.*, (xf+xt)*0.5 - sx as ax, (yf+yt)*0.5 - sy as ay, (zf+zt)*0.5 - sz as az, xt-xf as bx, yt-yf as by_, zt-zf as bz from edges e join srcs using (morphology)),
dirs as materialized (select *, 1.0 + 2.0 * pow(greatest(1e-3, least(1.0 - 1e-3, sin(case when ax = bx and ay = by_ and az = bz then 0 when ax*ax+ay*ay+az*az > 0 then
    acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+by_*by_+bz*bz))))) else 0 end))), 0.5) as pen from dv)
"""


def with_source(spark, sf, e):
    _, src, _ = start(spark, sf)
    return e.join(src, M)


def direction():
    return G.direction_penalty([F.col(c) for c in geo.triple("source_")], exponent=0.5, amplitude=2.0)


@shelf.add("g09_direction_penalty", f"""with {DIR_SQL} select morphology, f as "from", t as "to", {r6s('pen')} as penalty from dirs""")
def g09(spark, sf):
    _, e = edges(spark, sf)
    return with_source(spark, sf, e).select(M, "from", "to", r6(direction()).alias("penalty"))


def _depth_join(side: str, alias: str) -> str:
    return f"left join depths {alias} on {alias}.i = {idx_sql('x' + side)} and {alias}.j = {idx_sql('y' + side)} and {alias}.k = {idx_sql('z' + side)}"


DEPTH_SQL = f"""
{DIR_SQL}, {VOXELS_SQL}, {HEIGHTS_SQL},
dp as materialized (select d.*, 1.0 + 10.0 * (1 - exp(-greatest(0, least(1, abs(coalesce(u.depth, 0) - coalesce(v.depth, 0)) / length)) / 0.25)) as dpen
  from dirs d {_depth_join("f", "u")} {_depth_join("t", "v")})
"""


@shelf.add("g10_depth_penalty", f"""with {DEPTH_SQL} select morphology, f as "from", t as "to", {r6s('dpen')} as penalty from dp""")
def g10(spark, sf):
    _, e = edges(spark, sf)
    deep = G.with_depths(e, depths(spark, sf), GRID)
    return deep.select(M, "from", "to", r6(G.depth_penalty(sigma=0.25, amplitude=10.0)).alias("penalty"))


WEIGHT_SQL = f"""
{DEPTH_SQL}, {PREF_SQL},
gap as materialized (select n.morphology, n.id, min(sqrt((n.x-p.x)*(n.x-p.x) + (n.y-p.y)*(n.y-p.y) + (n.z-p.z)*(n.z-p.z))) as g from nodes n, pref p group by 1, 2),
pf as materialized (select dp.*, 1.0 + 1.0 * (1 - exp(-0.5 * (a.g + b.g) / 100.0)) as ppen from dp join gap a on a.morphology = dp.morphology and a.id = f join gap b on b.morphology = dp.morphology and b.id = t),
wt as materialized (select *, length * pen * dpen * ppen as weight from pf)
"""


def weighted_edges(spark, sf):
    n, e = edges(spark, sf)

    def make():
        deep = G.with_depths(e, depths(spark, sf), GRID)
        liked = G.preferred_factor(deep, n, preferred(spark, sf), [M], sigma=100.0, amplitude=1.0)
        out = G.weighted(with_source(spark, sf, liked), [direction(), G.depth_penalty(sigma=0.25, amplitude=10.0), F.col("preferred")])
        return out.select(M, "from", "to", "weight")

    return n, shared(spark, sf, "graph-weights", make)


@shelf.add("g11_preferred_factor", f"""with {WEIGHT_SQL} select morphology, f as "from", t as "to", {r6s('ppen')} as preferred from pf""", together=True)
def g11(spark, sf):
    n, e = edges(spark, sf)
    return G.preferred_factor(e, n, preferred(spark, sf), [M], sigma=100.0, amplitude=1.0).select(M, "from", "to", r6(F.col("preferred")).alias("preferred"))


@shelf.add("g12_weights", f"""with {WEIGHT_SQL} select morphology, f as "from", t as "to", {r6s('weight')} as weight from wt""", together=True)
def g12(spark, sf):
    return weighted_edges(spark, sf)[1].select(M, "from", "to", r6(F.col("weight")).alias("weight"))


@shelf.add("g13_terminal_penalty", f"""with {WEIGHT_SQL},
    fl as (select w.*, a.is_terminal as ft, b.is_terminal as tt from wt w join nodes a on a.morphology = w.morphology and a.id = f join nodes b on b.morphology = w.morphology and b.id = t),
    touch as (select morphology, f as id, bool_and(ft) as fa, bool_and(tt) as ta from fl group by 1, 2),
    pen as (select morphology, max(weight) + avg(weight) as p from wt group by 1)
    select fl.morphology, f as "from", t as "to", {r6s('weight + case when ft and tt and not (coalesce(a.fa, true) and coalesce(b.ta, true)) then p else 0 end')} as weight
    from fl join pen using (morphology) left join touch a on a.morphology = fl.morphology and a.id = f left join touch b on b.morphology = fl.morphology and b.id = t""", together=True)
def g13(spark, sf):
    n, w = weighted_edges(spark, sf)
    return G.terminal_penalty(w, n, [M]).select(M, "from", "to", r6(F.col("weight")).alias("weight"))


PATH_SQL = f"""
{EDGE_SQL},
arcs as materialized (select morphology, f as u, t as v, length as w from edges union all select morphology, t, f, length from edges),
sp(morphology, id, cost) using key (morphology, id) as (
  select morphology, id, 0.0::double from nodes where provider = 'source'
  union
  select a.morphology, a.v, min(s.cost + a.w) from sp s join arcs a on a.morphology = s.morphology and a.u = s.id
    left join recurring.sp r on r.morphology = a.morphology and r.id = a.v
  where r.cost is null or s.cost + a.w < r.cost group by 1, 2),
best as materialized (select * from sp),
pred as materialized (select b.morphology, b.id, b.cost, (select min(a.u) from arcs a join best p on p.morphology = a.morphology and p.id = a.u where a.morphology = b.morphology and a.v = b.id and p.cost + a.w = b.cost) as previous from best b),
sol as (select p.morphology, p.id, p.previous from pred p join nodes n using (morphology, id) where n.is_terminal and p.previous is not null
  union select q.morphology, q.id, q.previous from sol s join pred q on q.morphology = s.morphology and q.id = s.previous where q.previous is not null),
sole as materialized (select * from sol)
"""


def tree(spark, sf):
    n, e = edges(spark, sf)
    make = lambda: G.connecting_tree(n, e.withColumn("weight", F.col("length")), [M])[1]
    return shared(spark, sf, "graph-solution", make)


@shelf.add("g14_path_costs", f"with recursive {PATH_SQL} select morphology, id, {r6s('cost')} as cost from best")
def g14_costs(spark, sf):
    n, e = edges(spark, sf)
    ways = G.shortest_paths(e.withColumn("weight", F.col("length")), n.filter("provider = 'source'").select(M, "id"), [M])
    return ways.select(M, "id", r6(F.col("cost")).alias("cost"))


@shelf.add("g14_connecting_tree", f"""with recursive {PATH_SQL} select s.morphology, least(s.id, previous) as "from", greatest(s.id, previous) as "to", previous as parent, s.id as child,
      a.is_terminal as source_is_terminal, b.terminal_id as target_terminal_id from sole s
      join nodes a on a.morphology = s.morphology and a.id = least(s.id, previous) join nodes b on b.morphology = s.morphology and b.id = greatest(s.id, previous)""")
def g14(spark, sf):
    solution = tree(spark, sf)
    return solution.select(M, "from", "to", "parent", "child", "source_is_terminal", "target_terminal_id")


@shelf.add("t23_oriented_edges", f"""with recursive {PATH_SQL} select morphology, least(id, previous) as "from", greatest(id, previous) as "to", previous as parent, id as child, id < previous as reversed_edge from sole""")
def t23_orient(spark, sf):
    solution = tree(spark, sf)
    return G.orient_tree(solution, [M], root=0).drop("position")


@shelf.add("t23_trunk_sections", f"""with recursive {PATH_SQL},
    tops as (select s.morphology, count(*) as n, any_value(sx) as rx, (any_value(sx) + sum(q.x)) / (count(*) + 1) as hx, sum(q.x) as tx from sole s join srcs using (morphology) join nodes q on q.morphology = s.morphology and q.id = s.id where previous = 0 group by 1)
    select morphology, {r6s('rx')} as x_from, {r6s('case when n > 1 then hx else tx end')} as x_to, true as is_root from tops
    union all select s.morphology, {r6s('case when previous = 0 then hx else p.x end')}, {r6s('q.x')}, false from sole s join tops t using (morphology)
      join nodes p on p.morphology = s.morphology and p.id = previous join nodes q on q.morphology = s.morphology and q.id = s.id where not (previous = 0 and n = 1)""")
def t23(spark, sf):
    solution = tree(spark, sf)
    sections, _ = G.grow_trunk(solution, [M])
    return sections.select(M, r6(F.col("x_from")).alias("x_from"), r6(F.col("x_to")).alias("x_to"), (F.col("parent_section_id") == -1).alias("is_root"))
