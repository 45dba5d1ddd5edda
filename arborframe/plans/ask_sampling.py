"""Queries on source and target sampling.

Cells are customers placed in the voxel space; populations are suppliers, whose regions are
nations or, in the last two regions, whole regions; targets are the nations around them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import regions as R
from arborframe.operators import sampling as P
from arborframe.operators import voxels as V
from arborframe.operators.core import numbered, written
from arborframe.plans.ask_recipe import ATLAS_SQL, atlas_regions
from arborframe.plans.ask_voxels import GRID, idx_sql
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    GRID_DIM, GRID_OFF, VOXELS_SQL, r6, r6s, shared, table, u_sql, voxels,
)

shelf = Shelf()
M, A = "morphology", "axon_id"
SPAN = 140.0

BASE_SQL = f"""
{ATLAS_SQL.split("per as materialized")[0].rstrip().rstrip(",")}, {VOXELS_SQL},
lev as (select id, elder, (select count(*) from above b where b.id = a.elder) - 1 as st_level from above a),
cells as materialized (select c_custkey, c_custkey::varchar as morphology, {GRID_OFF} + {SPAN} * {u_sql("c_custkey", "'cx'")} as x,
  {GRID_OFF} + {SPAN} * {u_sql("c_custkey", "'cy'")} as y, {GRID_OFF} + {SPAN} * {u_sql("c_custkey", "'cz'")} as z from customer),
graft as materialized (select o_custkey::varchar as morphology, o_orderkey, case when o_orderpriority = '1-URGENT' then o_orderkey end as grafting_section_id,
  case when o_orderstatus = 'F' then o_totalprice / 10000 end as source_x, case when o_orderstatus = 'F' then 1.0 when o_orderstatus = 'P' then 2.0 end::double as source_y,
  case when o_orderstatus = 'F' then 3.0 end::double as source_z from orders),
ends as (select o_custkey::varchar as morphology, o_orderkey as section_id, {u_sql("o_orderkey", "'ex'")} as x from orders),
src as materialized (select c.*, g.o_orderkey, coalesce(g.grafting_section_id, -1) as grafting_section_id,
    c.x + case when source_x is null or source_y is null or source_z is null then coalesce(e.x, 0) else source_x end as source_x,
    v.region_id as source_brain_region_id
  from cells c left join graft g on g.morphology = c.morphology
  left join ends e on e.morphology = c.morphology and e.section_id = g.grafting_section_id
  left join voxels v on v.i = {idx_sql("c.x")} and v.j = {idx_sql("c.y")} and v.k = {idx_sql("c.z")}),
popl as materialized (select case when n_regionkey >= 3 then 10 + n_regionkey else 100 + n_nationkey end::bigint as brain_region_id, 'S' || s_suppkey as population_id,
   1 + s_suppkey % 7 as probability, s_suppkey, case when s_suppkey % 2 = 0 then 'L' else 'R' end as hemisphere from supplier join nation on n_nationkey = s_nationkey),
deepest as materialized (select l.id, arg_max(l.elder, st_level) as region from lev l where l.elder in (select brain_region_id from popl) group by 1)
"""


def cells(spark, sf):
    pos = [
        (F.lit(GRID_OFF) + F.lit(SPAN) * uniform("c_custkey", F.lit(f"c{a}"))).alias(a) for a in "xyz"
    ]
    return table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias(M), *pos)


def grafting(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    full = status == "F"
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias(M), "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("grafting_section_id"),
        F.when(full, price / 10000).alias("source_x"),
        F.when(full, F.lit(1.0)).when(status == "P", F.lit(2.0)).alias("source_y"),
        F.when(full, F.lit(3.0)).alias("source_z"),
    )


def section_ends(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias(M), F.col("o_orderkey").alias("section_id"),
        *[uniform("o_orderkey", F.lit(f"e{a}")).alias(a) for a in "xyz"])


def sources(spark, sf):
    return shared(spark, sf, "sources", lambda: P.source_points(
        cells(spark, sf), grafting(spark, sf), section_ends(spark, sf), voxels(spark, sf), GRID))


def population_options(spark, sf):
    s = table(spark, sf, "supplier").join(
        table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return s.select(
        F.when(F.col("n_regionkey") >= 3, 10 + F.col("n_regionkey")).otherwise(100 + F.col("s_nationkey")).cast("bigint").alias("brain_region_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("population_id"),
        (1 + F.col("s_suppkey") % 7).alias("probability"), "s_suppkey",
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("hemisphere"),
    )


@shelf.add("p01_source_points", f"""with recursive {BASE_SQL} select morphology, o_orderkey, grafting_section_id, {r6s("source_x")} as source_x, source_brain_region_id from src""")
def p01(spark, sf):
    return sources(spark, sf).select(M, "o_orderkey", "grafting_section_id", r6(F.col("source_x")).alias("source_x"), "source_brain_region_id")


@shelf.add("p02_existing_axons", """with ex as (select user_id::varchar as morphology, dense_rank() over (partition by user_id order by event_type) - 1 as axon_id, avg(value) as sx
      from events group by user_id, event_type),
    ask as (select c_custkey::varchar as morphology, c_nationkey % 4 as rid, c_acctbal from customer)
    select a.morphology, rid::bigint as rebuilt_existing_axon_id, null::bigint as grafting_section_id, round(c_acctbal, 6) + 0.0 as source_x, c_acctbal
      from ask a join ex on ex.morphology = a.morphology and ex.axon_id = rid
    union all select ex.morphology, ex.axon_id, -1, round(sx, 6) + 0.0, c_acctbal from ex join ask a on a.morphology = ex.morphology where a.rid <> ex.axon_id""")
def p02(spark, sf):
    from pyspark.sql import Window

    types = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("source_x"))
    w = Window.partitionBy("user_id").orderBy("event_type")  # five rows a group
    existing = types.select(
        F.col("user_id").cast("string").alias(M), (F.row_number().over(w) - 1).cast("bigint").alias(A),
        "source_x", F.lit(0.0).alias("source_y"), F.lit(0.0).alias("source_z"))
    ask = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias(M), (F.col("c_nationkey") % 4).cast("bigint").alias("rebuilt_existing_axon_id"),
        F.lit(None).cast("bigint").alias("grafting_section_id"), F.col("c_acctbal").alias("source_x"),
        F.lit(0.0).alias("source_y"), F.lit(0.0).alias("source_z"), "c_acctbal")
    return P.combine_existing_axons(ask, existing).select(
        M, "rebuilt_existing_axon_id", "grafting_section_id", r6(F.col("source_x")).alias("source_x"), "c_acctbal")


MAPPED_SQL = f"""
{BASE_SQL},
once as (select distinct morphology, source_brain_region_id, z from src join deepest on id = source_brain_region_id),
cum as (select *, sum(probability) over (partition by brain_region_id order by s_suppkey) as hi, sum(probability) over (partition by brain_region_id) as total from popl),
span as materialized (select *, hi / total::double as h, (hi - probability) / total::double as l from cum),
drawn as (select o.morphology, o.source_brain_region_id, s.population_id from once o join deepest d on d.id = o.source_brain_region_id
  join span s on s.brain_region_id = d.region
  and {u_sql("o.morphology", "o.source_brain_region_id", "'population'")} >= l and {u_sql("o.morphology", "o.source_brain_region_id", "'population'")} < h),
mapped as materialized (select s.*, coalesce(d.population_id, 'default') as population_id,
    row_number() over (partition by s.morphology order by coalesce(s.o_orderkey, -1)) - 1 as axon_id
  from src s left join drawn d on d.morphology = s.morphology and d.source_brain_region_id = s.source_brain_region_id)
"""


def elders(spark, sf):
    return shared(spark, sf, "atlas-elders", lambda: R.ascendants(atlas_regions(spark, sf)))


def mapped(spark, sf):
    return shared(spark, sf, "mapped", lambda: P.map_populations(
        sources(spark, sf), population_options(spark, sf), elders(spark, sf), order="s_suppkey",
    ).select(M, "o_orderkey", "source_brain_region_id", "population_id"))


@shelf.add("p03_populations", f"with recursive {MAPPED_SQL} select morphology, o_orderkey, source_brain_region_id, population_id from mapped")
def p03(spark, sf):
    return mapped(spark, sf).select(M, "o_orderkey", "source_brain_region_id", "population_id")


@shelf.add("p03_hemisphere_populations", f"""with recursive {BASE_SQL},
    once as (select distinct morphology, source_brain_region_id, case when z < {GRID.frontier(2)} then 'L' else 'R' end as hemisphere from src),
    cum as (select *, sum(probability) over w as hi, sum(probability) over (partition by brain_region_id, hemisphere) as total from popl window w as (partition by brain_region_id, hemisphere order by s_suppkey)),
    span as (select *, hi / total::double as h, (hi - probability) / total::double as l from cum),
    drawn as (select o.morphology, s.population_id from once o join deepest d on d.id = o.source_brain_region_id
      join span s on s.brain_region_id = d.region and s.hemisphere = o.hemisphere
      and {u_sql("o.morphology", "o.source_brain_region_id", "'population'")} >= l and {u_sql("o.morphology", "o.source_brain_region_id", "'population'")} < h)
    select c.morphology, coalesce(population_id, 'default') as population_id from cells c left join drawn d on d.morphology = c.morphology""")
def p03_side(spark, sf):
    only = P.source_points(cells(spark, sf), None, None, voxels(spark, sf), GRID)
    return P.map_populations(only, population_options(spark, sf), elders(spark, sf), order="s_suppkey",
                             hemisphere=V.hemisphere(F.col("z"), GRID)).select(M, "population_id")


def axons(spark, sf):
    rows = mapped(spark, sf).select(M, "o_orderkey", "population_id", F.coalesce("o_orderkey", F.lit(-1)).alias("_order"))
    return shared(spark, sf, "axons", lambda: P.axon_ids(rows, order="_order").drop("_order"))


@shelf.add("p04_axon_ids", f"with recursive {MAPPED_SQL} select morphology, o_orderkey, axon_id from mapped")
def p04(spark, sf):
    return axons(spark, sf).select(M, "o_orderkey", A)


def target_options(spark, sf):
    """Nations in the region of a supplier's nation are the targets of its population."""
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    other = n.select(F.col("n_nationkey").alias("t"), "n_regionkey")
    return s.join(other, "n_regionkey").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_population_id"),
        (F.lit(100) + F.col("t")).cast("bigint").alias("target_brain_region_id"),
        F.concat(F.lit("T"), F.col("t").cast("string")).alias("target_population_id"),
        (uniform("s_suppkey", "t", F.lit("p")) * 0.5).alias("probability"),
        F.when(F.col("t") % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("target_hemisphere"),
    )


CAND_SQL = f"""
{MAPPED_SQL},
opt as (select 'S' || s_suppkey as source_population_id, (100 + t.n_nationkey)::bigint as target_brain_region_id, 'T' || t.n_nationkey as target_population_id,
    {u_sql("s_suppkey", "t.n_nationkey", "'p'")} * 0.5 as p, case when t.n_nationkey % 2 = 0 then 'L' else 'R' end as target_hemisphere, t.n_nationkey as t, t.n_regionkey as tr
  from supplier join nation n on n.n_nationkey = s_nationkey join nation t on t.n_regionkey = n.n_regionkey),
cand as materialized (select m.*, o.* from mapped m join opt o on o.source_population_id = m.population_id)
"""


def candidates(spark, sf):
    """What the later steps draw by; order and place of an axon stay in its own table."""
    return P.candidate_targets(axons(spark, sf).select(M, A, "population_id"), target_options(spark, sf))


@shelf.add("p05_candidate_targets", f"""with recursive {CAND_SQL}
    select morphology, axon_id, target_population_id, {r6s("p")} as target_probability from cand
    union all select m.morphology, m.axon_id, null::varchar, null::double from mapped m
      where m.population_id is not null and not exists (select 1 from opt o where o.source_population_id = m.population_id)""")
def p05(spark, sf):
    found, missing = candidates(spark, sf)
    return found.select(M, A, "target_population_id", r6(F.col("target_probability")).alias("target_probability")).unionByName(
        missing.select(M, A, F.lit(None).cast("string").alias("target_population_id"), F.lit(None).cast("double").alias("target_probability")))


def _tries() -> str:
    parts = []
    for t in range(P.MAX_TRIES):
        u = u_sql("morphology", "axon_id", "target_population_id", f"'try{t}'")
        parts.append(f"case when {u} <= p then {t} end")
    return "[" + ", ".join(parts) + "]"


PICK_SQL = f"""
{CAND_SQL},
tried as materialized (select *, {_tries()} as hits from cand),
firsts as (select morphology, axon_id, min(list_min(hits)) as rnd from tried group by 1, 2),
picked as materialized (select t.* exclude (hits) from tried t join firsts f on f.morphology = t.morphology and f.axon_id = t.axon_id where list_contains(hits, rnd))
"""
REQ = [M, A, "target_population_id"]


def picked(spark, sf):
    found0, _ = candidates(spark, sf)
    found = shared(spark, sf, "candidates", lambda: found0)
    return P.pick_targets(found, request=REQ)


@shelf.add("p06_picked_targets", f"""with recursive {PICK_SQL} select morphology, axon_id, target_population_id from picked
    union all select morphology, axon_id, 'none' from firsts where rnd is null""")
def p06(spark, sf):
    rows, none = picked(spark, sf)
    return rows.select(*REQ).unionByName(none.select(M, A, F.lit("none").alias("target_population_id")))


def tuft_options(spark, sf):
    return table(spark, sf, "nation").filter("n_regionkey < 4").select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("target_population_id"),
        (F.lit(1.0) + F.col("n_nationkey") % 3).alias("mean_tuft_number"), F.lit(1.25).alias("std_tuft_number"))


_U1 = u_sql("morphology", "axon_id", "target_population_id", "'tuft1'")
_U2 = u_sql("morphology", "axon_id", "target_population_id", "'tuft2'")
TUFT_SQL = f"""
{PICK_SQL},
sized as (select *, case when tr < 4 then greatest(1, trunc(1.0 + t % 3 + 1.25 * sqrt(-2.0 * ln(1.0 - {_U1})) * cos(6.283185307179586 * {_U2}))::bigint) else 1 end as num from picked),
grown as materialized (select *, unnest(generate_series(0, num - 1)) as tuft_num from sized)
"""


def grown(spark, sf):
    return shared(spark, sf, "grown", lambda: P.tuft_numbers(
        picked(spark, sf)[0], tuft_options(spark, sf), request=REQ))


@shelf.add("p07_tuft_numbers", f"with recursive {TUFT_SQL} select morphology, axon_id, target_population_id, num as num_tufts_to_grow, tuft_num from grown")
def p07(spark, sf):
    return grown(spark, sf).select(*REQ, "num_tufts_to_grow", "tuft_num")


_R = "morphology || '|' || axon_id || '|' || target_population_id || '|' || tuft_num"


def _shift(axis: str, idx: str) -> str:
    return f"({idx} + 0.5) * {GRID_DIM} + ({GRID_OFF}) + ({u_sql(_R, chr(39) + 'shift_' + axis + chr(39))} - 0.5) * {GRID_DIM}"


COORD_SQL = f"""
{TUFT_SQL},
vrows as (select *, row_number() over (partition by region_id order by i, j, k) - 1 as rn, count(*) over (partition by region_id) as n from voxels),
found as (select g.morphology, g.axon_id, g.target_population_id, g.tuft_num, {_shift("x", "i")} as target_x, {_shift("y", "j")} as target_y, {_shift("z", "k")} as tz
  from grown g join vrows v on v.region_id = g.target_brain_region_id and rn = floor({u_sql(_R, "'voxel'")} * n)),
placedt as materialized (select g.*, target_x, target_y, case when target_hemisphere = 'L' and tz >= {GRID.frontier(2)} or target_hemisphere = 'R' and tz < {GRID.frontier(2)} then {2 * GRID.frontier(2)} - tz else tz end as target_z,
    row_number() over (partition by g.morphology, g.axon_id order by g.target_brain_region_id, g.tuft_num) as terminal_id
  from grown g left join found f on f.morphology = g.morphology and f.axon_id = g.axon_id and f.target_population_id = g.target_population_id and f.tuft_num = g.tuft_num)
"""


def placed(spark, sf):
    mask = voxels(spark, sf).withColumnRenamed("region_id", "target_brain_region_id")
    rows = grown(spark, sf).select(*REQ, "tuft_num", "target_brain_region_id", "target_hemisphere")
    return shared(spark, sf, "placed", lambda: P.target_coordinates(
        rows, mask, GRID, request=[*REQ, "tuft_num"], side="target_hemisphere"))


@shelf.add("p08_target_coordinates", f"with recursive {COORD_SQL} select morphology, axon_id, target_population_id, tuft_num, {r6s('target_x')} as target_x, {r6s('target_y')} as target_y, {r6s('target_z')} as target_z from placedt")
def p08(spark, sf):
    return placed(spark, sf).select(*REQ, "tuft_num", *[r6(F.col(c)).alias(c) for c in geo.triple("target_")])


def terminals(spark, sf):
    rows = placed(spark, sf)
    return P.terminal_ids(rows, ["target_brain_region_id", "tuft_num"], slice_by=F.floor(F.col("target_brain_region_id") / 4))


@shelf.add("p10_terminal_ids", f"with recursive {COORD_SQL} select morphology, axon_id, target_population_id, tuft_num, terminal_id from placedt")
def p10(spark, sf):
    return terminals(spark, sf).select(*REQ, "tuft_num", "terminal_id")


PRECISION = 25.0
MERGE_SQL = f"""
{COORD_SQL},
near as materialized (select a.morphology, a.axon_id, a.terminal_id as a, b.terminal_id as b from placedt a join placedt b
  on a.morphology = b.morphology and a.axon_id = b.axon_id
  where (a.target_x-b.target_x)**2 + (a.target_y-b.target_y)**2 + (a.target_z-b.target_z)**2 <= {PRECISION**2}),
reach as (select morphology, axon_id, a, b from near union select r.morphology, r.axon_id, r.a, n.b from reach r join near n
  on n.morphology = r.morphology and n.axon_id = r.axon_id and n.a = r.b),
lab as (select morphology, axon_id, a as terminal_id, min(b) as merged_id from reach group by 1, 2, 3)
"""


def merged(spark, sf):
    def make():
        rows = written(terminals(spark, sf), "terminals")
        return P.merge_close_targets(rows, PRECISION)

    return shared(spark, sf, "merged", make)


@shelf.add("p11_merged_targets", f"with recursive {MERGE_SQL} select p.morphology, p.axon_id, target_population_id, tuft_num, coalesce(merged_id, terminal_id) as terminal_id from placedt p left join lab using (morphology, axon_id, terminal_id)")
def p11(spark, sf):
    return merged(spark, sf).select(*REQ, "tuft_num", "terminal_id")


@shelf.add("p12_unique_terminals", f"""with recursive {MERGE_SQL} select p.morphology, p.axon_id, coalesce(merged_id, terminal_id) as terminal_id, arg_min(target_population_id, target_brain_region_id * 1000 + tuft_num) as target_population_id
    from placedt p left join lab using (morphology, axon_id, terminal_id) group by 1, 2, 3""")
def p12(spark, sf):
    rows = merged(spark, sf).select(M, A, "terminal_id", "target_population_id", "target_brain_region_id", "tuft_num")
    return P.unique_terminals(rows, ["target_brain_region_id", "tuft_num"]).select(M, A, "terminal_id", "target_population_id")


@shelf.add("p13_failed_axons", f"""with recursive {PICK_SQL} select morphology, axon_id from mapped m where not exists (select 1 from picked p where p.morphology = m.morphology and p.axon_id = m.axon_id)""")
def p13(spark, sf):
    rows, _ = picked(spark, sf)
    return P.failed_axons(axons(spark, sf).select(M, A).join(rows.select(*REQ), [M, A], "left"))


@shelf.add("p14_random_seeds", f"""select morphology, row_number() over (order by u, morphology) - 1 as seed from (select user_id::varchar as morphology, {u_sql("user_id", "'seed'")} as u from events group by user_id)""")
def p14(spark, sf):
    return P.random_seeds(table(spark, sf, "events").select(F.col("user_id").cast("string").alias(M)))


_WORDS = " + ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint" for i in range(8))
SEED_SQL = f"(({_WORDS}) % 4294967295)"


@shelf.add("i01_named_seeds", f"select morphology, {SEED_SQL} as seed from (select c_name as morphology, sha256(c_name) as h from customer)")
def i01(spark, sf):
    return P.named_seeds(table(spark, sf, "customer").select(F.col("c_name").alias(M)))


@shelf.add("p09_weighted_choice", f"""select o_custkey, arg_min(o_orderkey, -ln(1.0 - {u_sql("o_orderkey", "'choice'")}) / o_totalprice) as o_orderkey from orders where o_totalprice > 0 group by 1""")
def p09(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("_salt", F.lit("choice"))
    return P.weighted_choice(rows, ["o_custkey"], weight="o_totalprice", request=["o_orderkey", "_salt"]).select("o_custkey", "o_orderkey")


# --- barcodes: tufts are parts, edges are order lines ------------------------------------------

BARCODE_SQL = f"""
term as (select o_custkey::varchar as morphology, 0::bigint as axon_id, o_orderkey as terminal_id, case when o_orderstatus = 'P' then 'none' else 'B' || (o_orderkey % 20) end as target_population_id from orders),
edge as materialized (select l_orderkey as terminal_id, l_linenumber * 1000000 + l_partkey as section_id, l_returnflag = 'A' as reversed_edge, l_linestatus = 'O' as is_source from lineitem),
ends as (select t.*, e.section_id, e.is_source, e.is_source <> e.reversed_edge as use_parent from term t join edge e using (terminal_id)),
one as (select morphology, axon_id, terminal_id, target_population_id,
    arg_min(section_id, {u_sql("morphology", "axon_id", "terminal_id", "section_id", "'edge'")}) as section_id,
    arg_min(use_parent, {u_sql("morphology", "axon_id", "terminal_id", "section_id", "'edge'")}) as use_parent
  from (select distinct * from ends) group by 1, 2, 3, 4),
tuft as (select case when p_size > 40 then 'default' else 'B' || (p_partkey % 20) end as population_id, p_size as weight, p_partkey from part),
cum as (select *, sum(weight) over (partition by population_id order by p_partkey) as hi, sum(weight) over (partition by population_id) as total from tuft),
asked as (select o.*, case when target_population_id in (select population_id from tuft) then target_population_id else 'default' end as population_id,
    {u_sql("morphology", "axon_id", "terminal_id", "target_population_id", "'barcode'")} as u from one o)
"""


def tuft_pool(spark, sf):
    from pyspark.sql import functions as F

    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.when(size > 40, F.lit(P.DEFAULT_POPULATION)).otherwise(F.concat(F.lit("B"), (F.col("p_partkey") % 20).cast("string"))).alias("population_id"),
        size.cast("bigint").alias("weight"), F.col("p_partkey").alias("tuft_order"), "p_partkey",
        F.array(uniform("p_partkey", F.lit("ox")), uniform("p_partkey", F.lit("oy")), uniform("p_partkey", F.lit("oz"))).alias("tuft_orientation"))


def barcode_terminals(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias(M), F.lit(0).cast("bigint").alias(A), F.col("o_orderkey").alias("terminal_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("none")).otherwise(F.concat(F.lit("B"), (F.col("o_orderkey") % 20).cast("string"))).alias("target_population_id"))


def barcodes(spark, sf):
    terms = barcode_terminals(spark, sf)
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("terminal_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("section_id"),
        (F.col("l_returnflag") == "A").alias("reversed_edge"), (F.col("l_linestatus") == "O").alias("is_source")).distinct()
    home = terms.select(M, A, "terminal_id")
    edges = lines.join(home, "terminal_id").select(
        M, A, F.when(F.col("is_source"), F.col("terminal_id")).alias("source_terminal_id"),
        F.when(~F.col("is_source"), F.col("terminal_id")).alias("target_terminal_id"),
        F.col("is_source").alias("source_is_terminal"), (~F.col("is_source")).alias("target_is_terminal"),
        "section_id", "reversed_edge")
    return P.pick_barcodes(terms, edges, tuft_pool(spark, sf))


@shelf.add("p15_picked_barcodes", f"""with {BARCODE_SQL} select morphology, terminal_id, target_population_id, section_id, p_partkey
    from asked a join cum c on c.population_id = a.population_id and u >= (hi - weight) / total::double and u < hi / total::double""")
def p15(spark, sf):
    return barcodes(spark, sf).select(M, "terminal_id", "target_population_id", "section_id", "p_partkey")


@shelf.add("p16_tuft_directions", f"""with o as (select p_partkey, {u_sql("p_partkey", "'ox'")} as x, {u_sql("p_partkey", "'oy'")} as y, {u_sql("p_partkey", "'oz'")} as z, radians(p_size::double) as a from part)
    select p_partkey, {r6s("cos(a) * x - sin(a) * y")} as dir_x, {r6s("sin(a) * x + cos(a) * y")} as dir_y, {r6s("z")} as dir_z from o""")
def p16(spark, sf):
    a = F.radians(F.col("weight").cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = F.array(F.array(F.cos(a), -F.sin(a), zero), F.array(F.sin(a), F.cos(a), zero), F.array(zero, zero, one))
    out = P.tuft_directions(tuft_pool(spark, sf).withColumn("target_orientation", turn))
    return out.select("p_partkey", *[r6(F.col(f"dir_{a}")).alias(f"dir_{a}") for a in "xyz"])


@shelf.add("p17_random_cells", f"""with recursive {ATLAS_SQL.split("per as materialized")[0].rstrip().rstrip(",")}, {VOXELS_SQL},
    ok as (select *, row_number() over (order by i, j, k) - 1 as rn, count(*) over () as n from voxels where region_id not in (-1, 0)),
    req as (select row_number() over (order by c_custkey) as r, count(*) over () as m from customer),
    pos as (select req.*, region_id, {f"(i + 0.5) * {GRID_DIM} + ({GRID_OFF}) + ({u_sql('r', chr(39) + 'shift_x' + chr(39))} - 0.5) * {GRID_DIM}"} as x from req join ok on rn = floor({u_sql("r", "'voxel'")} * n))
    select 'cell_' || lpad(r::varchar, length(m::varchar)::integer, '0') as morphology, {r6s("x")} as x, region_id as atlas_id, acronym as region from pos left join atlas on atlas.id = region_id""")
def p17(spark, sf):
    customers = table(spark, sf, "customer")
    count = customers.count()
    req = numbered(customers.select("c_custkey", F.lit(1).alias("_all")), ["_all"], "c_custkey", "n", start=1)
    grid = voxels(spark, sf)
    mask = grid.filter("region_id not in (-1, 0)")
    out = P.random_cells(mask, grid, atlas_regions(spark, sf), GRID, req, count=count, prefix="cell_")
    return out.select(M, r6(F.col("x")).alias("x"), "atlas_id", "region")
