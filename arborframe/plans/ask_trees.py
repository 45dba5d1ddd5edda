"""Queries on trees: sections, paths, ancestors, measures, subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import trees as T
from arborframe.operators.core import written
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    AXON, FOREST_SQL, POINTS_SQL, forest, points, r6, r6s, shared, table, u_sql,
)

shelf = Shelf()
M = "morphology"

SECTIONED_SQL = f"""
{POINTS_SQL.replace("points as (", "points as materialized (")},
cc as materialized (
  select morphology, parent_id as point_id, count(*) as n_children
  from points where parent_id <> -1 group by all
),
flagged as materialized (
  select p.*, coalesce(c.n_children, 0) as n_children,
    coalesce(q.parent_id <> -1 and qc.n_children = 1, false) as linked
  from points p
  left join cc c on c.morphology = p.morphology and c.point_id = p.point_id
  left join points q on q.morphology = p.morphology and q.point_id = p.parent_id
  left join cc qc on qc.morphology = p.morphology and qc.point_id = p.parent_id
),
walk as (
  select morphology, point_id, point_id as head, 0::bigint as steps from flagged where not linked
  union all
  select f.morphology, f.point_id, w.head, w.steps + 1
  from flagged f join walk w on f.morphology = w.morphology and f.parent_id = w.point_id
  where f.linked
),
sectioned as materialized (
  select f.*, case when f.parent_id = -1 then -1 else w.head end as section_id,
    w.steps as sub_segment_num, f.parent_id = -1 or f.n_children = 0 as is_terminal
  from flagged f join walk w on f.morphology = w.morphology and f.point_id = w.point_id
)
"""

SECTIONS_SQL = f"""
{SECTIONED_SQL},
seg as materialized (
  select s.*, q.x as x_from, q.y as y_from, q.z as z_from, q.section_id as parent_section_id,
    sqrt((s.x - q.x) * (s.x - q.x) + (s.y - q.y) * (s.y - q.y) + (s.z - q.z) * (s.z - q.z)) as len
  from sectioned s join sectioned q on s.morphology = q.morphology and s.parent_id = q.point_id
),
sections as materialized (
  select morphology, section_id,
    arg_min(parent_section_id, sub_segment_num) as parent_section_id,
    arg_min(parent_id, sub_segment_num) as first_point,
    arg_max(point_id, sub_segment_num) as last_point,
    count(*) + 1 as n_points,
    arg_max(n_children, sub_segment_num) as n_children,
    sum(len) as length,
    arg_min(x_from, sub_segment_num) as x_first, arg_min(y_from, sub_segment_num) as y_first,
    arg_min(z_from, sub_segment_num) as z_first,
    arg_max(x, sub_segment_num) as x_last, arg_max(y, sub_segment_num) as y_last,
    arg_max(z, sub_segment_num) as z_last
  from seg group by morphology, section_id
),
up as materialized (
  select morphology, section_id, section_id as ancestor, parent_section_id as nxt, 0 as steps
  from sections
  union all
  select u.morphology, u.section_id, s.section_id, s.parent_section_id, u.steps + 1
  from up u join sections s on s.morphology = u.morphology and s.section_id = u.nxt
)
"""

CLOSURE_SQL = f"""
{POINTS_SQL.replace("points as (", "points as materialized (")},
closure as materialized (
  select morphology, point_id, point_id as ancestor, parent_id as nxt, 0::bigint as steps
  from points
  union all
  select c.morphology, c.point_id, p.point_id, p.parent_id, c.steps + 1
  from closure c join points p on p.morphology = c.morphology and p.point_id = c.nxt
)
"""


def sectioned(spark, sf):
    return shared(spark, sf, "sectioned", lambda: T.assign_sections(points(spark, sf)))


def section_table(spark, sf):
    return shared(spark, sf, "sections", lambda: T.sections(sectioned(spark, sf)))


def roots_of(spark, sf):
    return forest(spark, sf).filter(T.is_root()).select(
        M, "neurite", "type", F.col("event_id").alias("order"), "x", "y", "z"
    )


@shelf.add(
    "t01_sections",
    f"""with recursive {SECTIONS_SQL}
    select morphology, section_id, parent_section_id, first_point, last_point, n_points,
      n_children = 0 as is_leaf, {r6s("length")} as length from sections""",
)
def t01(spark, sf):
    return section_table(spark, sf).select(
        M, "section_id", "parent_section_id", "first_point", "last_point", "n_points", "is_leaf",
        r6(F.col("length")).alias("length"),
    )


@shelf.add(
    "t02_axons",
    f"""with {FOREST_SQL},
    ax as (select morphology, neurite,
             row_number() over (partition by morphology order by event_id) - 1 as axon_id
           from forest where parent_id = -1 and type = {AXON})
    select morphology, axon_id, count(*) as n_points, {r6s("sum(x)")} as sum_x
    from forest join ax using (morphology, neurite) group by all""",
)
def t02(spark, sf):
    return (
        T.axons(forest(spark, sf), roots_of(spark, sf), axon_type=AXON)
        .groupBy(M, "axon_id")
        .agg(F.count(F.lit(1)).alias("n_points"), r6(F.sum("x")).alias("sum_x"))
    )


@shelf.add(
    "t03_nodes_edges",
    f"""with recursive {SECTIONED_SQL},
    nodes as (select *, case when parent_id = -1 then -1 else point_id end as id from sectioned)
    select s.morphology, q.id as source, s.id as target, {r6s("q.x")} as x_from,
      {r6s("s.x")} as x_to, s.section_id as section_id_to, s.sub_segment_num as sub_segment_num_to,
      q.section_id as section_id_from, s.is_terminal as is_terminal_to
    from nodes s join nodes q on s.morphology = q.morphology and s.parent_id = q.point_id""",
)
def t03(spark, sf):
    nodes, edges = T.nodes_and_edges(sectioned(spark, sf))
    return T.edges_with_coords(nodes, edges).select(
        M, "source", "target", r6(F.col("x_from")).alias("x_from"), r6(F.col("x_to")).alias("x_to"),
        "section_id_to", "sub_segment_num_to", "section_id_from", "is_terminal_to",
    )


@shelf.add(
    "t03_section_end_edges",
    f"""with recursive {SECTIONS_SQL}
    select s.morphology, coalesce(q.last_point, -1) as source, s.last_point as target,
      {r6s("s.x_last")} as x_to, s.n_children = 0 as is_terminal_to
    from sections s left join sections q
      on s.morphology = q.morphology and s.parent_section_id = q.section_id""",
)
def t03_ends(spark, sf):
    base = sectioned(spark, sf)
    nodes, edges = T.nodes_and_edges(base, keep_section_segments=False)
    return T.edges_with_coords(nodes, edges).select(
        M, "source", "target", r6(F.col("x_to")).alias("x_to"), "is_terminal_to"
    )


@shelf.add(
    "t04_terminals",
    f"""with {POINTS_SQL},
    leaves as (select p.* from points p where parent_id <> -1 and not exists
      (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id))
    select morphology, point_id, 0::bigint as terminal_id, {r6s("x")} as x, {r6s("radius")} as radius
    from points where parent_id = -1
    union all
    select morphology, point_id, row_number() over (partition by morphology order by point_id),
      {r6s("x")}, {r6s("radius")} from leaves""",
)
def t04(spark, sf):
    return T.terminals(points(spark, sf)).select(
        M, "point_id", "terminal_id", r6(F.col("x")).alias("x"), r6(F.col("radius")).alias("radius")
    )


@shelf.add(
    "t05_root_paths",
    f"""with recursive {CLOSURE_SQL}
    select morphology, point_id, string_agg(ancestor::varchar, '>' order by steps desc) as path
    from closure group by all""",
)
def t05(spark, sf):
    paths = T.root_paths(points(spark, sf), [M], node="point_id", parent="parent_id")
    return paths.select(
        M, "point_id", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path")
    )


@shelf.add(
    "t06_terminals_below",
    f"""with recursive {CLOSURE_SQL},
    leaves as (select morphology, point_id from points p where parent_id <> -1 and not exists
      (select 1 from points c where c.morphology = p.morphology and c.parent_id = p.point_id))
    select morphology, c.ancestor as node_id, count(*) as n_terminals, min(point_id) as lowest,
      max(point_id) as highest, sum(point_id)::bigint as id_sum
    from closure c join leaves using (morphology, point_id) group by all""",
)
def t06(spark, sf):
    pts = points(spark, sf)
    leaves = T.terminals(pts).filter("terminal_id > 0")
    rel = T.terminals_below(pts, leaves, [M], node="point_id", parent="parent_id")
    return rel.groupBy(M, F.col("point_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_terminals"), F.min("terminal").alias("lowest"),
        F.max("terminal").alias("highest"), F.sum("terminal").alias("id_sum"),
    )


MEMBERS_SQL = """
members as (select morphology, event_type as grp, point_id from points)
"""


@shelf.add(
    "t07_common_ancestor",
    f"""with recursive {CLOSURE_SQL}, {MEMBERS_SQL},
    sizes as (select morphology, grp, count(*) as size from members group by all),
    shared as (
      select morphology, grp, ancestor, max(steps) as s from members
      join closure using (morphology, point_id) join sizes using (morphology, grp)
      group by morphology, grp, ancestor, size having count(*) = size)
    select morphology, grp, count(*) as path_nodes, arg_min(ancestor, s) as common_ancestor
    from shared group by all""",
)
def t07(spark, sf):
    pts = points(spark, sf)
    members = pts.select(M, F.col("event_type").alias("grp"), "point_id")
    path = T.common_path(pts, members, [M], ["grp"], node="point_id", parent="parent_id")
    return path.groupBy(M, "grp").agg(
        F.count(F.lit(1)).alias("path_nodes"),
        F.max(F.when(F.col("is_lowest"), F.col("ancestor"))).alias("common_ancestor"),
    )


@shelf.add(
    "t08_section_measures",
    f"""with recursive {SECTIONS_SQL},
    pd as materialized (select u.morphology, u.section_id, sum(a.length) as path_distance
           from up u join sections a on a.morphology = u.morphology and a.section_id = u.ancestor
           group by all),
    starts as (select morphology, arg_min(x_first, section_id) x0, arg_min(y_first, section_id) y0,
                 arg_min(z_first, section_id) z0 from sections where parent_section_id = -1 group by 1),
    below as (select u.morphology, u.ancestor as section_id, sum(s.length) as path_length,
                max(pd.path_distance) as max_path_extent
              from up u join sections s on s.morphology = u.morphology and s.section_id = u.section_id
              join pd on pd.morphology = u.morphology and pd.section_id = u.section_id group by all)
    select s.morphology, s.section_id, {r6s("path_distance")} as path_distance,
      {r6s("sqrt((x_last-x0)*(x_last-x0)+(y_last-y0)*(y_last-y0)+(z_last-z0)*(z_last-z0))")} as radial_distance,
      {r6s("path_length")} as path_length, {r6s("max_path_extent")} as max_path_extent
    from sections s join pd on pd.morphology = s.morphology and pd.section_id = s.section_id
    join below b on b.morphology = s.morphology and b.section_id = s.section_id
    join starts t on t.morphology = s.morphology""",
)
def t08(spark, sf):
    out = T.section_measures(section_table(spark, sf))
    names = ["path_distance", "radial_distance", "path_length", "max_path_extent"]
    return out.select(M, "section_id", *[r6(F.col(n)).alias(n) for n in names])


@shelf.add(
    "t09_segment_lengths",
    f"""with {POINTS_SQL}
    select p.morphology, count(*) as n_segments,
      {r6s("sum(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)))")} as total_length,
      {r6s("max(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)))")} as longest
    from points p join points q on p.morphology = q.morphology and p.parent_id = q.point_id
    group by all""",
)
def t09(spark, sf):
    seg = T.with_parent_point(points(spark, sf))
    length = geo.distance(geo.triple("", "_from"), geo.triple("", "_to"))
    return seg.groupBy(M).agg(
        F.count(F.lit(1)).alias("n_segments"), r6(F.sum(length)).alias("total_length"),
        r6(F.max(length)).alias("longest"),
    )


SUBSET_SQL = f"""
{CLOSURE_SQL}, {MEMBERS_SQL},
sizes as (select morphology, grp, count(*) as size from members group by all),
reached as materialized (
  select morphology, grp, ancestor, count(*) as n, max(steps) as s, size
  from members join closure using (morphology, point_id) join sizes using (morphology, grp)
  group by morphology, grp, ancestor, size),
lowest as (select morphology, grp, arg_min(ancestor, s) as ancestor from reached where n = size
           group by all)
"""


@shelf.add(
    "t14_tuft_subset",
    f"""with recursive {SUBSET_SQL}
    select r.morphology, r.grp, r.ancestor as point_id, l.ancestor is not null as is_common_ancestor
    from reached r left join lowest l
      on r.morphology = l.morphology and r.grp = l.grp and r.ancestor = l.ancestor
    where r.n < r.size or l.ancestor is not null""",
)
def t14(spark, sf):
    pts = points(spark, sf)
    members = pts.select(M, F.col("event_type").alias("grp"), "point_id")
    return T.tuft_nodes(pts, members, [M], ["grp"], node="point_id", parent="parent_id")


@shelf.add(
    "t15_trunk_and_clustered",
    f"""with recursive {SECTIONS_SQL},
    has_leaf as (select distinct u.morphology, u.ancestor as section_id from up u
      join sections s on s.morphology = u.morphology and s.section_id = u.section_id
      join points p on p.morphology = s.morphology and p.point_id = s.last_point
      where p.event_type = 'click'),
    trunk as (select s.* from sections s where parent_section_id = -1 or
      exists (select 1 from has_leaf h where h.morphology = s.morphology and h.section_id = s.section_id)),
    centres as (select morphology, avg(x_last) as x, avg(y_last) as y, avg(z_last) as z
      from sections group by 1),
    added as (select t.morphology, t.section_id as parent_section_id,
        sqrt((t.x_last-c.x)*(t.x_last-c.x)+(t.y_last-c.y)*(t.y_last-c.y)+(t.z_last-c.z)*(t.z_last-c.z)) as length
      from trunk t join centres c using (morphology))
    select morphology, parent_section_id, section_id, {r6s("length")} as length, false as is_added from trunk
    union all select morphology, parent_section_id, null, {r6s("length")}, true from added""",
)
def t15(spark, sf):
    table = section_table(spark, sf)
    ends = points(spark, sf).filter("event_type = 'click'").select(
        M, F.col("point_id").alias("last_point")
    )
    members = table.join(ends, [M, "last_point"], "left_semi")
    kept = T.ancestors(table, [M], node="section_id", parent="parent_section_id", of=members)
    centres = table.groupBy(M).agg(*[F.avg(f"{a}_last").alias(a) for a in "xyz"])
    kept = kept.select(M, F.col("ancestor").alias("section_id"))
    trunk_ids = table.filter("parent_section_id = -1").select(M, "section_id").unionByName(kept)
    added = trunk_ids.distinct().join(centres, M)
    _trunk, clustered = T.trunk_and_clustered(table, kept, added)
    return clustered.select(
        M, "parent_section_id", "section_id", r6(F.col("length")).alias("length"), "is_added"
    )


@shelf.add(
    "t16_resized_root",
    f"""with recursive {SECTIONS_SQL},
    dir as (select morphology, {u_sql("morphology", "'ux'")} as ax, {u_sql("morphology", "'uy'")} as ay,
      {u_sql("morphology", "'uz'")} as az from (select distinct morphology from sections)),
    unit as (select *, sqrt(ax*ax+ay*ay+az*az) as n from dir)
    select s.morphology, section_id,
      {r6s("case when parent_section_id = -1 then x_last - ax / n else x_first end")} as x_first,
      {r6s("case when parent_section_id = -1 then y_last - ay / n else y_first end")} as y_first,
      {r6s("case when parent_section_id = -1 then 1.0 else length end")} as length
    from sections s join unit using (morphology)""",
)
def t16(spark, sf):
    table = section_table(spark, sf)
    raw = [uniform(M, F.lit(f"u{a}")) for a in "xyz"]
    size = geo.norm(raw)
    toward = table.select(M).distinct().select(
        M, *[(c / size).alias(f"u{a}") for a, c in zip("xyz", raw)]
    )
    return T.resize_root_section(table, toward, [M]).select(
        M, "section_id", *[r6(F.col(c)).alias(c) for c in ("x_first", "y_first", "length")]
    )


@shelf.add(
    "t17_kept_neurites",
    f"""with {FOREST_SQL},
    roots as (select morphology, neurite, type,
      row_number() over (partition by morphology order by event_id) - 1 as pos
      from forest where parent_id = -1 and type = {AXON})
    select morphology, neurite, 'second axon' as kept from roots where pos = 1
    union all
    select morphology, neurite, 'not an axon' from forest f
      where parent_id = -1 and type <> {AXON}""",
)
def t17(spark, sf):
    roots = roots_of(spark, sf)
    second = T.keep_neurites(roots, neurite_type=AXON, position=1)
    other = T.keep_neurites(roots, neurite_type=AXON, drop=True)
    return second.select(M, "neurite", F.lit("second axon").alias("kept")).unionByName(
        other.select(M, "neurite", F.lit("not an axon").alias("kept"))
    )


@shelf.add(
    "t18_recentered",
    f"""with {POINTS_SQL},
    o as (select morphology, x as ox, y as oy, z as oz from points where parent_id = -1),
    home as (select morphology, 1000 * {u_sql("morphology", "'at'")} as ax from o)
    select p.morphology, point_id, {r6s("x - ox + ax")} as x, {r6s("y - oy")} as y, {r6s("z - oz")} as z
    from points p join o using (morphology) join home using (morphology)""",
)
def t18(spark, sf):
    pts = points(spark, sf)
    origin = pts.filter(T.is_root()).select(M, "x", "y", "z")
    home = origin.select(
        M, (F.lit(1000) * uniform(M, F.lit("at"))).alias("atlas_x"),
        F.lit(0.0).alias("atlas_y"), F.lit(0.0).alias("atlas_z"),
    )
    return T.translate(T.recenter(pts, origin), home).select(
        M, "point_id", *[r6(F.col(a)).alias(a) for a in "xyz"]
    )


@shelf.add(
    "t19_bounding_box",
    f"""with {POINTS_SQL},
    b as (select morphology, min(x) as x0, max(x) as x1, min(z) as z0, max(z) as z1 from points group by 1)
    select morphology, {r6s("x0 - greatest((x1 - x0) * 0.1, 9.0)")} as x_min,
      {r6s("x1 + greatest((x1 - x0) * 0.1, 9.0)")} as x_max,
      {r6s("z0 - greatest((z1 - z0) * 0.1, 9.0)")} as z_min from b""",
)
def t19(spark, sf):
    box = T.bounding_box(points(spark, sf), [M], relative_buffer=0.1, absolute_buffer=9.0)
    return box.select(M, *[r6(F.col(c)).alias(c) for c in ("x_min", "x_max", "z_min")])


# sections cut once more where the event type changes, so that many have a single child
TYPED_SQL = f"""
{SECTIONED_SQL},
typed as materialized (
  select f.morphology, f.point_id, f.parent_id, q.parent_id = -1 as at_root,
    coalesce(f.linked and f.event_type = q.event_type, false) as same
  from flagged f left join points q on f.morphology = q.morphology and f.parent_id = q.point_id
),
typed_walk as (
  select morphology, point_id, point_id as piece from typed where not same
  union all
  select t.morphology, t.point_id, w.piece
  from typed t join typed_walk w on t.morphology = w.morphology and t.parent_id = w.point_id where t.same
),
pieces as materialized (
  select t.morphology, t.point_id as section_id, case when t.at_root then -1 else w.piece end as parent_section_id
  from typed t join typed_walk w on t.morphology = w.morphology and t.parent_id = w.point_id where not t.same
)
"""


def typed_pieces(spark, sf):
    """Section table of the pieces: (morphology, section_id, parent_section_id, n_children)."""

    def make():
        pts = sectioned(spark, sf)
        up = pts.select(
            M, F.col("point_id").alias("parent_id"), F.col("event_type").alias("_type"),
            (F.col("section_id") == -1).alias("_at_root"), F.col("n_children").alias("_kids"),
        )
        linked = pts.join(up, [M, "parent_id"], "left").withColumn(
            "_same", F.coalesce((F.col("_kids") == 1) & ~F.col("_at_root") & (F.col("event_type") == F.col("_type")), F.lit(False))
        )
        linked = written(linked.select(M, "point_id", "parent_id", "_same", "_at_root"), "typed-points")
        heads = written(T.run_heads(linked, [M], node="point_id", parent="parent_id", linked="_same"), "typed-heads")
        above = heads.select(M, F.col("point_id").alias("parent_id"), F.col("head").alias("_above"))
        own = linked.filter(~F.col("_same")).join(above, [M, "parent_id"]).select(
            M, F.col("point_id").alias("section_id"),
            F.when(F.col("_at_root"), F.lit(-1)).otherwise(F.col("_above")).cast("bigint").alias("parent_section_id"),
        )
        kids = own.groupBy(M, F.col("parent_section_id").alias("section_id")).agg(F.count(F.lit(1)).alias("kids"))
        return own.join(kids, [M, "section_id"], "left").withColumn("n_children", F.coalesce("kids", F.lit(0))).drop("kids")

    return shared(spark, sf, "typed-pieces", make)


@shelf.add(
    "t20_merged_chains",
    f"""with recursive {TYPED_SQL},
    kid as materialized (select morphology, parent_section_id, count(*) as kids from pieces group by 1, 2),
    lk as materialized (select o.*, coalesce(k.kids = 1, false) and o.parent_section_id <> -1 as linked from pieces o left join kid k
      on o.morphology = k.morphology and o.parent_section_id = k.parent_section_id),
    ch as (select morphology, section_id, section_id as chain_id, 0::bigint as chain_pos from lk where not linked
      union all select l.morphology, l.section_id, c.chain_id, c.chain_pos + 1 from lk l
      join ch c on c.morphology = l.morphology and c.section_id = l.parent_section_id where l.linked)
    select * from ch""",
)
def t20(spark, sf):
    return T.merge_chains(typed_pieces(spark, sf)).select(M, "section_id", "chain_id", "chain_pos")


# every event type of a user is a line, read along the line of the type after it
_TYPES = ("click", "error", "purchase", "signup", "view")
_READ = list(zip(_TYPES, (*_TYPES[1:], _TYPES[0])))
_READ_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _READ)


@shelf.add(
    "t21_resampled",
    f"""with {POINTS_SQL},
    lines as materialized (
      select morphology, event_type, point_id, x, y, z, radius,
        row_number() over w as pos,
        coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)
          + (z - lag(z) over w) * (z - lag(z) over w)), 0) as step
      from points
      window w as (partition by morphology, event_type order by point_id)),
    d as materialized (select *, sum(step) over (partition by morphology, event_type order by pos) as cum from lines),
    c as (select *, max(cum) over (partition by morphology, event_type) as total from d),
    t as materialized (select *, case when total > 0 then least(cum / total, 1.0) else 0 end as t from c),
    reads as (select * from (values {_READ_SQL}) r(line, target)),
    have as (select morphology, line, target, t as t0, radius as v0,
        coalesce(lead(t) over w, t) as t1, coalesce(lead(radius) over w, radius) as v1
      from t join reads on event_type = line window w as (partition by morphology, event_type order by pos)),
    want as (select morphology, event_type as target, point_id, t from t)
    select w.morphology, h.line, w.point_id, {r6s("arg_max(v0 + case when t1 > t0 then (t - t0) / (t1 - t0) else 0 end * (v1 - v0), t0)")} as radius
    from want w join have h on w.morphology = h.morphology and w.target = h.target and t >= t0 and t <= t1 group by all""",
)
def t21(spark, sf):
    pts = points(spark, sf).select(M, "event_type", "point_id", "x", "y", "z", "radius")
    line = pts.withColumn("line", F.col("event_type"))
    target = pts.withColumn("line", F.create_map(*[F.lit(v) for a, b in _READ for v in (b, a)])[F.col("event_type")])
    out = T.resample(line, target, [M, "line"], order="point_id", value="radius")
    return out.select(M, "line", "point_id", r6(F.col("radius")).alias("radius"))


@shelf.add(
    "t22_axon_starts",
    f"""with {FOREST_SQL},
    o as (select morphology, arg_min(x, event_id) as ox, arg_min(y, event_id) as oy from forest
          where parent_id = -1 group by 1)
    select morphology, row_number() over (partition by morphology order by event_id) - 1 as axon_id,
      {r6s("x - ox")} as x, {r6s("y - oy")} as y
    from forest join o using (morphology) where parent_id = -1 and type = {AXON}""",
)
def t22(spark, sf):
    roots = roots_of(spark, sf)
    first = roots.groupBy(M).agg(F.min_by(F.struct("x", "y", "z"), "order").alias("o"))
    origin = first.select(M, "o.x", "o.y", "o.z")
    return T.existing_axon_starts(roots, origin, axon_type=AXON).select(
        M, "axon_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y")
    )


@shelf.add(
    "t22_section_ends",
    f"""with recursive {SECTIONS_SQL}
    select s.morphology, s.section_id, {r6s("x_last - x")} as x, {r6s("z_last - z")} as z
    from sections s join points o on o.morphology = s.morphology and o.parent_id = -1""",
)
def t22_ends(spark, sf):
    origin = points(spark, sf).filter(T.is_root()).select(M, "x", "y", "z")
    return T.section_ends_from_origin(section_table(spark, sf), origin).select(
        M, "section_id", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z")
    )


@shelf.add(
    "t24_points_or_empty",
    f"""with {POINTS_SQL}, names as (select distinct c_custkey::varchar as morphology from customer)
    select n.morphology, p.point_id, {r6s("p.x")} as x from names n left join points p
      on n.morphology = p.morphology""",
)
def t24(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias(M))
    return T.points_or_empty(names, points(spark, sf)).select(
        M, "point_id", r6(F.col("x")).alias("x")
    )


@shelf.add(
    "t25_section_graph",
    f"""with recursive {SECTIONS_SQL}
    select s.morphology, s.parent_section_id as source, s.section_id as target,
      {r6s("coalesce(q.x_last, s.x_first)")} as x_from, {r6s("s.x_last")} as x_to
    from sections s left join sections q
      on s.morphology = q.morphology and s.parent_section_id = q.section_id""",
)
def t25(spark, sf):
    nodes, edges = T.section_graph(section_table(spark, sf))
    return T.edges_with_coords(nodes, edges).select(
        M, "source", "target", r6(F.col("x_from")).alias("x_from"), r6(F.col("x_to")).alias("x_to")
    )
