"""Queries on shape measures, length maps and the comparison of two collections.

The compared collection holds the same trees with shifted points; either side lacks the users
whose customer belongs to one market segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import compare as D
from arborframe.operators import morphometrics as S
from arborframe.operators import trees as T
from arborframe.operators import voxels as V
from arborframe.operators.core import written
from arborframe.plans.ask_trees import SECTIONED_SQL, SECTIONS_SQL, section_table, sectioned
from arborframe.plans.registry import Shelf
from arborframe.plans.views import POINTS_SQL, SEGMENTS_SQL, points, r6, r6s, segments, shared, table, u_sql

shelf = Shelf()
M = "morphology"
SIZES = [(20.0, 20.0, 20.0), (35.0, 30.0, 25.0)]
KEYS = [M, "size_id"]


def ang(a: str, b: str) -> str:
    """SQL text of the angle between two vectors given as comma separated components."""
    p, q = [s.strip() for s in a.split(",")], [s.strip() for s in b.split(",")]
    dot = " + ".join(f"({u}) * ({v})" for u, v in zip(p, q))
    na = " + ".join(f"({u}) * ({u})" for u in p)
    nb = " + ".join(f"({u}) * ({u})" for u in q)
    same = " and ".join(f"({u}) = ({v})" for u, v in zip(p, q))
    return f"(case when {same} then 0 when ({na}) > 0 and ({nb}) > 0 then acos(greatest(-1.0, least(1.0, ({dot}) / (sqrt({na}) * sqrt({nb}))))) end)"


@shelf.add("t10_angles", f"""with {SEGMENTS_SQL}, o as (select morphology, x as ox, y as oy, z as oz from points where point_id = 1)
    select s.morphology, segment_id, {r6s(ang("x_to - x_from, y_to - y_from, z_to - z_from", "x_to - ox, y_to - oy, z_to - oz"))} as angle from segments s join o using (morphology)""")
def t10(spark, sf):
    origin = points(spark, sf).filter("point_id = 1").select(M, *[F.col(a).alias(f"o{a}") for a in "xyz"])
    seg = segments(spark, sf).join(origin, M)
    angle = geo.angle(geo.vector(S.FROM, S.TO), geo.vector(["ox", "oy", "oz"], S.TO))
    return seg.select(M, "segment_id", r6(angle).alias("angle"))


@shelf.add("t11_segment_angles", f"with {SEGMENTS_SQL} select morphology, segment_id as point_id, {r6s(ang('x_to - x_from, y_to - y_from, z_to - z_from', '0.0, 1.0, 0.0'))} as angle from segments")
def t11(spark, sf):
    return S.segment_angles(points(spark, sf), [M]).select(M, "point_id", r6(F.col("angle")).alias("angle"))


@shelf.add("t12_trunk_properties", f"""with recursive {SECTIONED_SQL},
    seg as materialized (select s.*, q.x as x0, q.y as y0, q.z as z0 from sectioned s join sectioned q on q.morphology = s.morphology and q.point_id = s.parent_id),
    l as (select morphology, avg(sqrt((x-x0)**2 + (y-y0)**2 + (z-z0)**2)) as ml, stddev_pop(sqrt((x-x0)**2 + (y-y0)**2 + (z-z0)**2)) as sl from seg group by 1),
    mnd as (select s.morphology, {ang("s.x0 - s.x, s.y0 - s.y, s.z0 - s.z", "n.x - s.x, n.y - s.y, n.z - s.z")} as a from seg s join sectioned n on n.morphology = s.morphology and n.parent_id = s.point_id where s.n_children = 1),
    m as (select morphology, avg(a) as ma, stddev_pop(a) as sa from mnd group by 1)
    select l.morphology, {r6s('ml')} as mean_segment_lengths, {r6s('sl')} as std_segment_lengths, {r6s('ma')} as mean_segment_meander_angles, {r6s('sa')} as std_segment_meander_angles from l left join m using (morphology)""")
def t12(spark, sf):
    out = S.trunk_properties(sectioned(spark, sf), [M])
    return out.select(M, *[r6(F.col(c)).alias(c) for c in out.columns if c != M])


PD_SQL = f"""
{SECTIONS_SQL},
pd as materialized (select u.morphology, u.section_id, sum(a.length) as path_distance from up u join sections a on a.morphology = u.morphology and a.section_id = u.ancestor group by all),
top as materialized (select u.morphology, u.ancestor as section_id, max(path_distance) as top from up u join pd using (morphology, section_id) group by all)
"""


@shelf.add("t13_barcodes", f"""with recursive {PD_SQL},
    rk as (select t.*, s.parent_section_id, row_number() over (partition by morphology, parent_section_id order by top desc, section_id) as r from top t join sections s using (morphology, section_id))
    select k.morphology, k.section_id, {r6s('top')} as birth, {r6s('coalesce(p.path_distance, 0)')} as death from rk k left join pd p on p.morphology = k.morphology and p.section_id = k.parent_section_id
    where k.parent_section_id = -1 or r > 1""")
def t13(spark, sf):
    return S.barcodes(section_table(spark, sf), [M]).select(M, "section_id", r6(F.col("birth")).alias("birth"), r6(F.col("death")).alias("death"))


@shelf.add("t13_radial_barcodes", f"""with recursive {SECTIONS_SQL},
    starts as (select morphology, arg_min(x_first, section_id) x0, arg_min(y_first, section_id) y0, arg_min(z_first, section_id) z0 from sections where parent_section_id = -1 group by 1),
    rd as materialized (select s.*, sqrt((x_last-x0)*(x_last-x0)+(y_last-y0)*(y_last-y0)+(z_last-z0)*(z_last-z0)) as rad from sections s join starts using (morphology)),
    top as (select u.morphology, u.ancestor as section_id, max(rad) as top from up u join rd using (morphology, section_id) where n_children = 0 group by all),
    rk as (select t.*, s.parent_section_id, row_number() over (partition by morphology, parent_section_id order by top desc, section_id) as r from top t join sections s using (morphology, section_id))
    select k.morphology, k.section_id, {r6s('top')} as birth, {r6s('coalesce(p.rad, 0)')} as death from rk k left join rd p on p.morphology = k.morphology and p.section_id = k.parent_section_id
    where k.parent_section_id = -1 or r > 1""")
def t13_radial(spark, sf):
    return S.barcodes(section_table(spark, sf), [M], metric="radial_distance").select(M, "section_id", r6(F.col("birth")).alias("birth"), r6(F.col("death")).alias("death"))


# --- morphometrics ------------------------------------------------------------------------------

MORPH_SQL = f"""
{PD_SQL},
starts as (select morphology, arg_min(x_first, section_id) x0, arg_min(y_first, section_id) y0, arg_min(z_first, section_id) z0 from sections where parent_section_id = -1 group by 1),
cnt as materialized (select u.morphology, u.ancestor as section_id, count(*) as nb, sum(s.length) as pl from up u join sections s using (morphology, section_id) group by all),
dep as (select morphology, section_id, max(steps) as bo from up group by all),
tot as (select morphology, sum(length) as tl from sections group by 1),
kid as (select s.morphology, s.parent_section_id as section_id, abs(arg_min(nb, s.section_id) - arg_max(nb, s.section_id)) / (arg_min(nb, s.section_id) + arg_max(nb, s.section_id))::double as asym,
   abs(arg_min(pl, s.section_id) - arg_max(pl, s.section_id)) as dl, arg_min(x_last, s.section_id) ax, arg_min(y_last, s.section_id) ay, arg_min(z_last, s.section_id) az,
   arg_max(x_last, s.section_id) bx, arg_max(y_last, s.section_id) by_, arg_max(z_last, s.section_id) bz from sections s join cnt using (morphology, section_id) group by 1, 2),
sf as materialized (select s.*, bo, path_distance, sqrt((x_last-x0)**2 + (y_last-y0)**2 + (z_last-z0)**2) as rad, n_children = 2 as bif, n_children = 0 as leaf,
    length / sqrt((x_last-x_first)**2 + (y_last-y_first)**2 + (z_last-z_first)**2) as tort,
    case when n_children = 2 then asym end as asym, case when n_children = 2 then dl / tl end as asyml,
    case when n_children = 2 then {ang("ax - x_last, ay - y_last, az - z_last", "bx - x_last, by_ - y_last, bz - z_last")} end as bang
  from sections s join dep using (morphology, section_id) join pd using (morphology, section_id) join starts using (morphology) join tot using (morphology) left join kid using (morphology, section_id))
"""
_SQL_FEATURES = {
    "partition_asymmetry": "asym", "partition_asymmetry_length": "asyml", "remote_bifurcation_angles": "bang",
    "section_bif_branch_orders": "case when bif then bo end", "section_bif_lengths": "case when bif then length end",
    "section_bif_radial_distances": "case when bif then rad end", "section_branch_orders": "bo", "section_lengths": "length",
    "section_path_distances": "path_distance", "section_radial_distances": "rad",
    "section_term_branch_orders": "case when leaf then bo end", "section_term_lengths": "case when leaf then length end",
    "section_term_radial_distances": "case when leaf then rad end", "section_tortuosity": "tort",
}
_AGG = {"sum": "sum", "mean": "avg", "min": "min", "max": "max"}
_MORPH_COLS = ", ".join(
    f"{r6s(f'{_AGG[m]}({e})::double')} as {m}_{name}" for name, e in _SQL_FEATURES.items() for m in S.FEATURES[name]
)
_WIDE_SQL = f"""select morphology, {r6s("count(*) filter (bif)::double")} as sum_number_of_bifurcations, {r6s("count(*) filter (leaf)::double")} as sum_number_of_leaves, {_MORPH_COLS},
  count(*)::double as mean_number_of_sections_per_neurite, count(*)::double as sum_number_of_sections_per_neurite, {r6s("sum(length)")} as mean_total_length_per_neurite from sf group by 1"""


# A section has order n + 1 when it or one below it has two children of order n or more; twelve
# orders need 2048 leaves in one tree.
ORDERS_SQL = f"""
{SECTIONS_SQL},
lines as (
  select morphology, section_id as low, section_id as high, parent_section_id as nxt from sections
  union all
  select l.morphology, l.low, s.section_id, s.parent_section_id
  from lines l join sections s on s.morphology = l.morphology and s.section_id = l.nxt),
lineage as materialized (select morphology, low, high from lines),
o1 as materialized (select morphology, section_id from sections),
""" + ",\n".join(
    f"""o{n + 1} as materialized (select distinct l.morphology, l.high as section_id from lineage l join (
    select k.morphology, parent_section_id as low from o{n} k join sections s using (morphology, section_id)
    where parent_section_id <> -1 group by 1, 2 having count(*) >= 2) f using (morphology, low))"""
    for n in range(1, 12)
)
_EVERY_ORDER = " union all ".join(f"select {n} as strahler, * from o{n}" for n in range(1, 13))


def wide_features(spark, sf):
    def make():
        sec = section_table(spark, sf).withColumn("neurite", F.lit(0))
        return S.morphometrics(sec, [M], ["neurite"])

    return shared(spark, sf, "features", make)


_ORDER_MEANS = f"""orders as (select morphology, avg(strahler) as mean_order from (
    select morphology, section_id, max(strahler) as strahler from ({_EVERY_ORDER}) group by 1, 2) group by 1)"""


_FEATURES_SQL = f"{MORPH_SQL.replace(SECTIONS_SQL, ORDERS_SQL)}, {_ORDER_MEANS}"
_ALL_WIDE_SQL = f"""select w.*, {r6s("mean_order")} as mean_section_strahler_orders
    from ({_WIDE_SQL}) w join orders using (morphology)"""


@shelf.add("m05_morphometrics", f"with recursive {_FEATURES_SQL} {_ALL_WIDE_SQL}")
def m05(spark, sf):
    out = wide_features(spark, sf)
    return out.select(M, *[r6(F.col(c)).alias(c) for c in out.columns if c != M])


@shelf.add("m05_strahler_orders", f"""with recursive {ORDERS_SQL}
    select morphology, strahler, count(*) as n_sections from (
      select morphology, section_id, max(strahler)::integer as strahler from ({_EVERY_ORDER}) group by 1, 2) group by 1, 2""")
def m05_strahler(spark, sf):
    out = S.strahler_orders(section_table(spark, sf), [M])
    return out.groupBy(M, "strahler").agg(F.count(F.lit(1)).alias("n_sections"))


# --- length maps --------------------------------------------------------------------------------

SIDE_SQL = f"""
{POINTS_SQL.replace("points as (", "points as materialized (")},
rpts as materialized (select morphology, point_id, parent_id, x, y, z from points where morphology in (select c_custkey::varchar from customer where c_mktsegment <> 'MACHINERY')),
cpts as materialized (select morphology, point_id, parent_id, x + 5 * {u_sql("event_id", "'dx'")} as x, y, z from points where morphology in (select c_custkey::varchar from customer where c_mktsegment <> 'BUILDING'))
"""


def maps_sql(p: str) -> str:
    cuts = " union all ".join(
        f"""select morphology, size_id, segment_id, (off_{a} + k * dim_{a} - {a}_from) / ({a}_to - {a}_from) as t from (
        select *, unnest(generate_series(floor((least({a}_from, {a}_to) - off_{a}) / dim_{a})::bigint + 1, floor((greatest({a}_from, {a}_to) - off_{a}) / dim_{a})::bigint)) as k from {p}sg)"""
        for a in "xyz")
    idx = ", ".join(f"floor((({a}_from + m * ({a}_to - {a}_from)) - off_{a}) / dim_{a})::integer as {n}" for a, n in zip("xyz", "ijk"))
    grid = ", ".join(
        f"dim_{a}, (greatest(floor(({a}1 - {a}0) / dim_{a}), 1) + 3)::integer as n_{a}, {a}0 - (1.5 - ((r{a} - {a}0) / dim_{a} - floor((r{a} - {a}0) / dim_{a}))) * dim_{a} as off_{a}"
        for a in "xyz")
    box = ", ".join(f"min({a}) as {a}0, max({a}) as {a}1, max(case when parent_id = -1 then {a} end) as r{a}" for a in "xyz")
    return f"""
{p}seg as materialized (select a.morphology, a.point_id as segment_id, b.x as x_from, b.y as y_from, b.z as z_from, a.x as x_to, a.y as y_to, a.z as z_to
  from {p}pts a join {p}pts b on a.morphology = b.morphology and a.parent_id = b.point_id),
{p}box as (select morphology, {box} from {p}pts group by 1),
{p}grid as materialized (select morphology, size_id, {grid} from {p}box, (values (0, 20.0::double, 20.0::double, 20.0::double), (1, 35.0::double, 30.0::double, 25.0::double)) s(size_id, dim_x, dim_y, dim_z)),
{p}sg as materialized (select * from {p}seg join {p}grid using (morphology)),
{p}cut as (select distinct * from ({cuts}) where t > 0 and t < 1
  union all select morphology, size_id, segment_id, 0.0::double from {p}sg union all select morphology, size_id, segment_id, 1.0::double from {p}sg),
{p}span as (select *, (t0 + t1) * 0.5 as m from (select *, t as t0, lead(t) over (partition by morphology, size_id, segment_id order by t) as t1 from {p}cut) where t1 is not null),
{p}piece as (select morphology, size_id, {idx}, n_x, n_y, n_z, sqrt((x_to-x_from)*(x_to-x_from) + (y_to-y_from)*(y_to-y_from) + (z_to-z_from)*(z_to-z_from)) * (t1 - t0) as len from {p}span join {p}sg using (morphology, size_id, segment_id)),
{p}map as materialized (select morphology, size_id, i, j, k, sum(len) as length from {p}piece where i >= 0 and j >= 0 and k >= 0 and i < n_x and j < n_y and k < n_z group by all)
"""


def sides(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias(M), "c_mktsegment")
    pts = shared(spark, sf, "plain-points", lambda: points(spark, sf)).select(M, "point_id", "parent_id", "event_id", "x", "y", "z")
    ref = pts.join(cust.filter("c_mktsegment <> 'MACHINERY'"), M, "left_semi")
    comp = pts.join(cust.filter("c_mktsegment <> 'BUILDING'"), M, "left_semi").withColumn(
        "x", F.col("x") + 5 * uniform("event_id", F.lit("dx")))
    return ref, comp


def length_maps(spark, sf, side):
    pts = sides(spark, sf)[side]
    seg = T.with_parent_point(pts, [M]).select(M, *S.FROM, *S.TO)
    roots = pts.filter("parent_id = -1").select(M, "x", "y", "z")
    grids = shared(spark, sf, f"grids-{side}", lambda: V.centred_grids(seg, roots, [M], SIZES))
    return grids, shared(spark, sf, f"maps-{side}", lambda: V.length_maps(seg, grids, [M]))


@shelf.add("m01_length_maps", f"with {SIDE_SQL}, {maps_sql('r')} select morphology, size_id, i, j, k, {r6s('length')} as length from rmap")
def m01(spark, sf):
    return length_maps(spark, sf, 0)[1].withColumn("length", r6(F.col("length")))


@shelf.add("m02_matched_maps", f"""with {SIDE_SQL}, {maps_sql('r')}, {maps_sql('c')} select coalesce(r.morphology, c.morphology) as morphology, coalesce(r.size_id, c.size_id) as size_id,
    case when r.morphology is null then 'in compared only' when c.morphology is null then 'in reference only' else 'both' end as found from rgrid r full join cgrid c on r.morphology = c.morphology and r.size_id = c.size_id""")
def m02(spark, sf):
    return D.match_maps(length_maps(spark, sf, 0)[0], length_maps(spark, sf, 1)[0], KEYS)


DIFF_SQL = f"""
{SIDE_SQL}, {maps_sql('r')}, {maps_sql('c')},
al as materialized (select r.morphology, r.size_id, {", ".join(f"round((r.off_{a} - least(r.off_{a}, c.off_{a})) / r.dim_{a})::integer as r{a}, round((c.off_{a} - least(r.off_{a}, c.off_{a})) / r.dim_{a})::integer as c{a}" for a in "xyz")},
   {" * ".join(f"(r.n_{a} + round((r.off_{a} - least(r.off_{a}, c.off_{a})) / r.dim_{a}) + round((greatest(r.off_{a} + r.n_{a} * r.dim_{a}, c.off_{a} + c.n_{a} * r.dim_{a}) - r.off_{a} - r.n_{a} * r.dim_{a}) / r.dim_{a}))" for a in "xyz")} as nv
  from rgrid r join cgrid c on r.morphology = c.morphology and r.size_id = c.size_id),
ra as (select morphology, size_id, i + rx as i, j + ry as j, k + rz as k, length from rmap join al using (morphology, size_id)),
ca as (select morphology, size_id, i + cx as i, j + cy as j, k + cz as k, length from cmap join al using (morphology, size_id)),
df as materialized (select morphology, size_id, i, j, k, coalesce(ra.length, 0) as r, coalesce(ca.length, 0) as c, coalesce(ra.length, 0) - coalesce(ca.length, 0) as d from ra full join ca using (morphology, size_id, i, j, k))
"""


def difference(spark, sf):
    rg, rm = length_maps(spark, sf, 0)
    cg, cm = length_maps(spark, sf, 1)
    return D.map_difference(rm, cm, written(D.aligned_grids(rg, cg, KEYS), "shifts"), KEYS)


@shelf.add("m03_map_difference", f"with {DIFF_SQL} select morphology, size_id, i, j, k, {r6s('d')} as diff from df")
def m03(spark, sf):
    return difference(spark, sf).select(*KEYS, "i", "j", "k", r6(F.col("diff")).alias("diff"))


@shelf.add("m04_difference_stats", f"""with {DIFF_SQL},
    st as (select morphology, size_id, sum(abs(d)) as s, sum(d*d) as s2, sum(abs(r)) + sum(abs(c)) as t1, sum(r*r) + sum(c*c) as t2, max(abs(d)) as mx, min(abs(d)) as mn, count(*) as n, any_value(nv) as nv from df join al using (morphology, size_id) group by 1, 2)
    select morphology, size_id, {r6s('s / t1')} as l1, {r6s('sqrt(s2 / t2)')} as l2, {r6s('s')} as sum, {r6s('s / nv')} as mean, {r6s('case when n < nv then 0 else mn end')} as min, {r6s('mx')} as max,
      {r6s('sqrt(greatest(0, s2 / nv - (s / nv) * (s / nv)))')} as std from st""")
def m04(spark, sf):
    stats = D.difference_stats(difference(spark, sf), KEYS)
    return stats.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("l1", "l2", "sum", "mean", "min", "max", "std")])


# --- scores: users against the next user ----------------------------------------------------------

SCORE_SQL = f"""
{_FEATURES_SQL},
wide as materialized ({_ALL_WIDE_SQL}),
ord as (select morphology, row_number() over (order by morphology::bigint) - 1 as pos from wide),
lng as materialized (select morphology, feature, value from wide unpivot include nulls (value for feature in (columns(* exclude morphology)))),
sc as materialized (select r.morphology, r.feature, case when r.value is null or t.value is null then 'nan'::double when r.value = 0 then case when t.value = 0 then 0 when t.value > 0 then 'inf'::double else '-inf'::double end else (t.value - r.value) / r.value end::double as score
  from lng r join ord a using (morphology) join ord b on b.pos = a.pos + 1 join lng t on t.morphology = b.morphology and t.feature = r.feature)
"""


def scores(spark, sf):
    from arborframe.operators.core import numbered

    wide = wide_features(spark, sf)
    wide = written(wide.select(M, *[r6(F.col(c)).alias(c) for c in wide.columns if c != M]), "features")
    order = numbered(wide.select(M, F.col(M).cast("bigint").alias("_n"), F.lit(1).alias("_all")), ["_all"], "_n", "pos")
    order = written(order.select(M, "pos"), "order")
    nxt = order.select(F.col(M).alias("other"), (F.col("pos") - 1).alias("pos"))
    pairs = order.join(nxt, "pos").select(M, "other")
    ref = D.long_features(wide, [M])
    test = ref.withColumnRenamed(M, "other").join(pairs, "other").select(M, "feature", "value")
    return wide, D.relative_scores(ref, test, [M])


@shelf.add("m06_relative_scores", f"with recursive {SCORE_SQL} select morphology, feature, {r6s('score')} as score from sc")
def m06(spark, sf):
    return scores(spark, sf)[1].withColumn("score", r6(F.col("score")))


@shelf.add("m07_score_summary", f"""with recursive {SCORE_SQL} select morphology, {r6s('avg(least(abs(score), 1.0)) filter (not isnan(score))')} as mean_score, {r6s('stddev_pop(least(abs(score), 1.0)) filter (not isnan(score))')} as std_score, count(*) as n_scores from sc group by 1""")
def m07(spark, sf):
    out = D.score_summary(scores(spark, sf)[1], [M])
    return out.select(M, r6(F.col("mean_score")).alias("mean_score"), r6(F.col("std_score")).alias("std_score"), "n_scores")


@shelf.add("m07_score_matrix", f"""with recursive {SCORE_SQL} select morphology, {r6s("max(score) filter (feature = 'mean_section_lengths')")} as mean_section_lengths, {r6s("max(score) filter (feature = 'sum_number_of_leaves')")} as sum_number_of_leaves from sc group by 1""")
def m07_matrix(spark, sf):
    names = ["mean_section_lengths", "sum_number_of_leaves"]
    out = D.score_matrix(scores(spark, sf)[1], [M], names)
    return out.select(M, *[r6(F.col(n)).alias(n) for n in names])


@shelf.add("m07_paired_collections", """with a as (select c_name, c_nationkey, row_number() over (order by c_custkey) - 1 as pair from customer), b as (select s_name, s_nationkey, row_number() over (order by s_suppkey) - 1 as pair from supplier)
    select pair, c_name as ref_name, s_name as test_name, coalesce(c_nationkey = s_nationkey, false) as ok from a full join b using (pair)""")
def m07_pairs(spark, sf):
    ref = table(spark, sf, "customer").select(F.col("c_name").alias(M), F.col("c_nationkey").alias("mtype"), F.col("c_custkey").alias("order"))
    test = table(spark, sf, "supplier").select(F.col("s_name").alias(M), F.col("s_nationkey").alias("mtype"), F.col("s_suppkey").alias("order"))
    return D.paired(ref, test)


@shelf.add("m08_workflow_counts", """with r as (select case when o_orderstatus <> 'F' then 'x' end as basic, case when o_totalprice > 100000 then 'x' end as preferred from orders)
    select 'basic' as workflow, count(basic) as n_success, count(*) - count(basic) as n_failed from r union all select 'preferred', count(preferred), count(*) - count(preferred) from r""")
def m08(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "F", F.lit("x")).alias("synthesized_basic_path"),
        F.when(F.col("o_totalprice") > 100000, F.lit("x")).alias("synthesized_preferred_path"))
    return D.workflow_counts(o, ["basic", "preferred"])
