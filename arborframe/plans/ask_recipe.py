"""Queries on recipes.

The driver tables give one recipe document per region: a population per market segment, the
nations as subregions, projections from each region to the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.operators import recipe as E
from arborframe.operators import regions as R
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    GRID_DIM, HIERARCHY_SQL, POINTS_SQL, VOXELS_SQL, points, r6, r6s, shared, table, voxels,
)
from arborframe.sources.documents import read_recipe

shelf = Shelf()

# --- recipe documents -------------------------------------------------------------------------


def documents(spark, sf):
    """(doc_id, body): one JSON recipe per region, built from customers, nations and regions."""
    nation = table(spark, sf, "nation")
    cust = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    per = cust.join(nation, "n_nationkey").groupBy("n_regionkey", "c_mktsegment").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("l"), F.col("n_nationkey").cast("string")))).alias("subs"),
        F.round(F.avg("c_acctbal"), 2).alias("density"),
    )
    region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    name = F.concat(region, F.lit("_"), F.col("c_mktsegment"))
    single = per.select(
        "n_regionkey", name.alias("name"),
        F.to_json(F.struct(
            name.alias("name"),
            F.struct(region.alias("name"), F.col("subs").alias("subregions")).alias("atlas_region"),
            F.create_map(F.lit("synapse_type"), F.lit("EXC")).alias("filters"),
        )).alias("entry"),
    )
    wide = per.select(
        "n_regionkey", F.concat(F.lit("ALL"), F.col("n_regionkey").cast("string"), F.lit("_"), "c_mktsegment").alias("name"),
        F.to_json(F.struct(
            F.concat(F.lit("ALL"), F.col("n_regionkey").cast("string"), F.lit("_"), "c_mktsegment").alias("name"),
            F.array(F.struct(region.alias("name")), F.struct(F.lit("root").alias("name"))).alias("atlas_region"),
        )).alias("entry"),
    )
    pops = single.unionByName(wide).groupBy("n_regionkey").agg(
        F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list("entry"))), F.lit("]")).alias("pops"))
    # a projection from every population to the same segment of every other region
    other = per.select(F.col("n_regionkey").alias("to_region"), "c_mktsegment", F.col("density").alias("to_density"))
    to = F.concat(F.lit("R"), F.col("to_region").cast("string"))
    targets = per.join(other, "c_mktsegment").filter("n_regionkey <> to_region").select(
        "n_regionkey", name.alias("source"),
        F.struct(
            F.when((F.col("to_region") + F.col("n_regionkey")) % 3 == 0, to)
            .otherwise(F.concat(to, F.lit("_"), F.col("c_mktsegment"))).alias("population"),
            F.concat(name, F.lit("_to_"), to).alias("projection_name"),
            F.col("to_density").alias("density"),
            F.when((F.col("to_region") + F.col("n_regionkey")) % 2 == 0, F.lit("ipsilateral")).otherwise(F.lit("contralateral")).alias("hemisphere"),
            F.struct(
                F.concat(F.lit("flat_"), to).alias("base_system"), F.array(F.lit(0.0), F.col("to_region") + 0.5).alias("x"),
                F.array(F.lit(1.0), F.col("n_regionkey") + 0.25).alias("y"), (F.col("to_region") / 8.0).alias("mapping_variance"),
            ).alias("presynaptic_mapping"),
            F.array(
                F.struct(F.concat(F.lit("profile_"), (F.col("to_region") % 2).cast("string")).alias("name"), F.lit(0.75).alias("fraction")),
                F.struct(F.lit("rest").alias("name"), F.lit(0.25).alias("fraction")),
            ).alias("target_layer_profiles"),
            F.when(F.col("to_region") % 2 == 0, F.array(F.struct(F.lit("EXC").alias("name"), F.lit(1.0).alias("fraction")))).alias("synapse_types"),
        ).alias("target"),
        ((F.col("to_region") + 1) / 10.0).alias("strength"),
    )
    proj = targets.groupBy("n_regionkey", "source").agg(
        F.array_sort(F.collect_list(F.struct("target", "strength")), lambda a, b: F.when(a["target"]["projection_name"] < b["target"]["projection_name"], -1).otherwise(1)).alias("ts"))
    names = F.transform("ts", lambda t: t["target"]["projection_name"])
    projections = proj.groupBy("n_regionkey").agg(F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(
        F.to_json(F.struct("source", F.transform("ts", lambda t: t["target"]).alias("targets")))))), F.lit("]")).alias("projs"))
    n = F.size("ts")
    strengths = F.transform(F.sequence(F.lit(1), F.floor(n * (n - 1) / 2).cast("int")), lambda i: i + 1.5)
    ptypes = proj.filter("size(ts) > 1").groupBy("n_regionkey").agg(F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(
        F.to_json(F.struct(
            F.col("source").alias("population"),
            F.map_from_arrays(names, F.transform("ts", lambda t: t["strength"])).alias("fractions"),
            F.struct(names.alias("projections"), strengths.alias("strengths")).alias("interaction_mat"),
        ))))), F.lit("]")).alias("ptypes"))
    layer = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("l"), F.col("n_nationkey").cast("string")))).alias("ls"))
    # layers of even regions belong to profile_0, of odd regions to profile_1
    layers = layer.select("n_regionkey", F.to_json(F.array(
        F.struct(F.concat(F.lit("profile_"), (F.col("n_regionkey") % 2).cast("string")).alias("name"),
                 F.array(F.struct(F.col("ls").alias("layers"), (F.col("n_regionkey") + 0.5).alias("value")),
                         F.struct(F.array(F.lit("ALL")).alias("layers"), F.lit(1.0).alias("value"))).alias("relative_densities")))).alias("layers"))
    def field(key, col):
        return F.concat(F.lit(f'"{key}":'), F.coalesce(F.col(col), F.lit("[]")))
    return (
        pops.join(projections, "n_regionkey", "left").join(ptypes, "n_regionkey", "left").join(layers, "n_regionkey", "left")
        .select(F.col("n_regionkey").alias("doc_id"), F.concat(
            F.lit("{"), F.concat_ws(",", field("populations", "pops"), field("projections", "projs"),
            field("layer_profiles", "layers"), field("p-types", "ptypes")), F.lit("}")).alias("body"))
    )


def entries(spark, sf):
    return read_recipe(shared(spark, sf, "recipe", lambda: documents(spark, sf)))


def atlas_regions(spark, sf):
    """Hierarchy of the recipe: root, regions R0.., subregions R0;7 for their nations."""
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), F.lit("root").alias("acronym"))
    reg = table(spark, sf, "region").select((F.lit(10) + F.col("r_regionkey")).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("parent_id"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("acronym"))
    nat = table(spark, sf, "nation").select((F.lit(100) + F.col("n_nationkey")).cast("bigint").alias("id"), (F.lit(10) + F.col("n_regionkey")).cast("bigint").alias("parent_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(";"), F.col("n_nationkey").cast("string")).alias("acronym"))
    return root.unionByName(reg).unionByName(nat)


def populations(spark, sf, e=None):
    return shared(spark, sf, "populations", lambda: _populations(spark, sf, e or entries(spark, sf)))


def _populations(spark, sf, e):
    regions = atlas_regions(spark, sf)
    flat = E.name_subregions(E.flatten_populations(e["populations"]), remove_prefix=True)
    placed, _bad = E.region_ids(flat, regions)
    vol = R.volumes(voxels(spark, sf), R.descendants(regions), GRID_DIM**3)
    return E.volume_fractions(placed, vol, regions)


ATLAS_SQL = """
atlas as (select 1::bigint as id, -1::bigint as parent_id, 'root' as acronym
  union all select 10 + r_regionkey, 1, 'R' || r_regionkey from region
  union all select 100 + n_nationkey, 10 + n_regionkey, 'R' || n_regionkey || ';' || n_nationkey from nation),
above as (select id, id as elder, parent_id as nxt from atlas
  union all select a.id, t.id, t.parent_id from above a join atlas t on t.id = a.nxt),
per as materialized (select n_regionkey as r, c_mktsegment as seg, round(avg(c_acctbal), 2) as density
  from customer join nation on n_nationkey = c_nationkey group by 1, 2),
flatpop as materialized (
  select distinct 'R' || n_regionkey || '_' || c_mktsegment as pop_raw_name, 'R' || n_regionkey as region_acronym, 'l' || n_nationkey as sub_region
  from customer join nation on n_nationkey = c_nationkey
  union all select 'ALL' || r || '_' || seg, 'R' || r, null from per
  union all select 'ALL' || r || '_' || seg, 'root', null from per),
named as (select *, substr(sub_region, 2) as formatted_subregion, region_acronym || ';' || substr(sub_region, 2) as subregion_acronym from flatpop),
placed as materialized (select n.*, coalesce(a.id, b.id) as atlas_region_id, b.id as whole_id from named n
  left join atlas a on a.acronym = n.subregion_acronym left join atlas b on b.acronym = n.region_acronym)
"""
VOL_SQL = f"""
{ATLAS_SQL}, {VOXELS_SQL},
vol as materialized (select a.elder as id, count(v.i) as nb_voxels, count(v.i) * {GRID_DIM**3}::double as volume
  from above a left join voxels v on v.region_id = a.id group by 1),
pops as materialized (select p.*, v.volume as atlas_region_volume, v.nb_voxels,
  coalesce(case when w.volume > 0 then greatest(0, least(1, v.volume / w.volume)) end, 1)::double as sub_region_volume_frac
  from placed p left join vol v on v.id = p.atlas_region_id left join vol w on w.id = p.whole_id)
"""
TARGET_SQL = f"""
{VOL_SQL},
raw_targets as (select 'R' || a.r || '_' || a.seg as source, row_number() over (partition by a.r, a.seg order by b.r) - 1 as target_num,
    case when (a.r + b.r) % 3 = 0 then 'R' || b.r else 'R' || b.r || '_' || b.seg end as target_population_name,
    'R' || a.r || '_' || a.seg || '_to_R' || b.r as target_projection_name, b.density as target_density,
    'profile_' || b.r % 2 as target_layer_profile_name, (b.r + 1) / 10.0::double as strength
  from per a join per b on a.seg = b.seg and a.r <> b.r),
tflat as materialized (select t.*, p.pop_raw_name, p.sub_region, p.atlas_region_id from raw_targets t left join pops p on p.pop_raw_name = t.source),
popreg as (select distinct pop_raw_name, region_acronym from pops),
treg as materialized (
  select t.*, coalesce(pr.region_acronym, target_population_name) as target_region, a.id as target_region_atlas_id,
    c.acronym as target_subregion_acronym, c.id as target_subregion_atlas_id
  from tflat t left join popreg pr on pr.pop_raw_name = target_population_name
  left join atlas a on a.acronym = coalesce(pr.region_acronym, target_population_name)
  left join atlas c on c.parent_id = a.id
  where c.acronym in (select subregion_acronym from pops)),
subs as (select distinct subregion_acronym, sub_region, sub_region_volume_frac from pops),
profiles as materialized (select 'profile_' || r % 2 as name, r as rr, 0 as layer_profile_num, row_number() over (partition by r order by 'l' || n_nationkey) - 1 as layer_index, 'l' || n_nationkey as layer, r + 0.5::double as value
  from (select n_regionkey as r, n_nationkey from nation)
  union all select 'profile_' || r_regionkey % 2, r_regionkey, 1, 0, 'ALL', 1.0 from region where r_regionkey in (select r from per)),
dens as materialized (select t.*, coalesce(pf.value, 1)::double as dens, coalesce(pf.value, 1)::double * s.sub_region_volume_frac as prob
  from treg t left join subs s on s.subregion_acronym = t.target_subregion_acronym
  left join profiles pf on pf.name = t.target_layer_profile_name and pf.layer = s.sub_region),
norm as (select source, sub_region, target_projection_name, target_region, sum(prob) as nf from dens
  where sub_region is not null group by all),
lp as materialized (select d.*, coalesce(nf, 1)::double as nf, coalesce(case when coalesce(nf, 1) <> 0 then prob / coalesce(nf, 1) end, 1)::double as region_prob
  from dens d left join norm n on n.source = d.source and n.sub_region = d.sub_region
  and n.target_projection_name = d.target_projection_name and n.target_region = d.target_region)
"""


@shelf.add("e01_populations", f"with recursive {ATLAS_SQL} select * from flatpop")
def e01(spark, sf):
    return E.flatten_populations(entries(spark, sf)["populations"]).select("pop_raw_name", "region_acronym", "sub_region")


@shelf.add("e02_subregion_names", f"with recursive {ATLAS_SQL} select pop_raw_name, formatted_subregion, subregion_acronym from named")
def e02(spark, sf):
    flat = E.flatten_populations(entries(spark, sf)["populations"])
    return E.name_subregions(flat, remove_prefix=True).select("pop_raw_name", "formatted_subregion", "subregion_acronym")


@shelf.add("e03_region_ids", f"with recursive {ATLAS_SQL} select pop_raw_name, subregion_acronym, atlas_region_id from placed")
def e03(spark, sf):
    flat = E.name_subregions(E.flatten_populations(entries(spark, sf)["populations"]), remove_prefix=True)
    placed, _ = E.region_ids(flat, atlas_regions(spark, sf))
    return placed.select("pop_raw_name", "subregion_acronym", "atlas_region_id")


@shelf.add("e04_volume_fractions", f"with recursive {VOL_SQL} select pop_raw_name, subregion_acronym, atlas_region_volume, {r6s('sub_region_volume_frac')} as frac from pops")
def e04(spark, sf):
    return populations(spark, sf).select("pop_raw_name", "subregion_acronym", "atlas_region_volume", r6(F.col("sub_region_volume_frac")).alias("frac"))


@shelf.add("e05_layer_profiles", f"with recursive {TARGET_SQL} select name, layer_profile_num::integer as layer_profile_num, layer_index::integer as layer_index, layer, case when layer = 'ALL' then 'ALL' else substr(layer, 2) end as formatted_layer, value from profiles where rr in (select r from per)")
def e05(spark, sf):
    return E.flatten_layer_profiles(entries(spark, sf)["layer_profiles"])


@shelf.add("e06_projection_targets", f"""with recursive {TARGET_SQL} select source, target_num::integer as target_num, target_population_name, target_projection_name, {r6s('target_density', 2)} as target_density, target_layer_profile_name, sub_region,
    case when (source_r + target_r) % 2 = 0 then 'ipsilateral' else 'contralateral' end as target_hemisphere, 'flat_R' || target_r as base_system, target_r + 0.5::double as x_end, source_r + 0.25::double as y_end, target_r / 8.0::double as mapping_variance,
    2::integer as n_profiles, 0.25::double as last_fraction, case when target_r % 2 = 0 then 'EXC' end as synapse_type
    from (select *, substr(source, 2, 1)::integer as source_r, right(target_projection_name, 1)::integer as target_r from tflat)""")
def e06(spark, sf):
    e = entries(spark, sf)
    flat = E.flatten_projections(e["projections"], populations(spark, sf, e))
    at, profiles = F.col("topographical_mapping"), F.col("target_layer_profiles")
    return flat.select(
        "source", "target_num", "target_population_name", "target_projection_name", r6(F.col("target_density"), 2).alias("target_density"), "target_layer_profile_name", "sub_region",
        "target_hemisphere", at["base_system"].alias("base_system"), F.get(at["x"], F.lit(1)).alias("x_end"), F.get(at["y"], F.lit(1)).alias("y_end"),
        at["mapping_variance"].alias("mapping_variance"), F.size(profiles).alias("n_profiles"), F.get(profiles, F.size(profiles) - 1)["fraction"].alias("last_fraction"),
        F.get("target_synapse_types", F.lit(0))["name"].alias("synapse_type"))


@shelf.add("e06_duplicated_sources", """with p as (select n_regionkey as source_region, c_mktsegment as source, count(distinct c_nationkey) as n from customer join nation on n_nationkey = c_nationkey group by all)
    select source, count(*) as n from p group by 1 having count(*) > 1""")
def e06_dup(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = table(spark, sf, "customer").join(nation, "c_nationkey").select("n_regionkey", F.col("c_mktsegment").alias("source")).distinct()
    return E.duplicated_sources(rows)


def targets(spark, sf, e, pops):
    flat = E.flatten_projections(e["projections"], pops)
    return E.target_regions(flat, pops, atlas_regions(spark, sf))


@shelf.add("e08_target_regions", f"with recursive {TARGET_SQL} select source, sub_region, target_projection_name, target_region, target_region_atlas_id, target_subregion_acronym, target_subregion_atlas_id from treg")
def e08(spark, sf):
    e = entries(spark, sf)
    return targets(spark, sf, e, populations(spark, sf, e)).select(
        "source", "sub_region", "target_projection_name", "target_region", "target_region_atlas_id", "target_subregion_acronym", "target_subregion_atlas_id")


@shelf.add("e09_layer_probabilities", f"with recursive {TARGET_SQL} select source, sub_region, target_projection_name, target_subregion_acronym, {r6s('prob')} as prob, {r6s('nf')} as norm_factor, {r6s('region_prob')} as region_prob from lp")
def e09(spark, sf):
    e = entries(spark, sf)
    pops = populations(spark, sf, e)
    out = E.layer_probabilities(targets(spark, sf, e, pops), pops, E.flatten_layer_profiles(e["layer_profiles"]))
    return out.select("source", "sub_region", "target_projection_name", "target_subregion_acronym",
                      r6(F.col("target_layer_profile_prob")).alias("prob"), r6(F.col("target_layer_profile_norm_factor")).alias("norm_factor"),
                      r6(F.col("target_layer_profile_region_prob")).alias("region_prob"))


@shelf.add("e10_fractions", f"with recursive {TARGET_SQL} select source as pop_raw_name, target_projection_name, strength as target_projection_strength from raw_targets where source in (select source from raw_targets group by 1 having count(*) > 1)")
def e10(spark, sf):
    return E.flatten_fractions(entries(spark, sf)["p_types"])


@shelf.add("e10_interaction_strengths", f"""with recursive {TARGET_SQL},
    nm as (select source, target_projection_name as p, row_number() over (partition by source order by target_projection_name) - 1 as pos, count(*) over (partition by source) as n from raw_targets)
    select a.source as population, a.p as row_proj, b.p as col_proj,
      case when a.pos = b.pos then 1.0 else (row_number() over (partition by a.source, a.pos < b.pos order by least(a.pos, b.pos), greatest(a.pos, b.pos))) + 1.5 end::double as strength
    from nm a join nm b on a.source = b.source where a.n > 1 and a.pos = b.pos
    union all
    select source, case when d = 0 then p else q end, case when d = 0 then q else p end, s from (
      select a.source, a.p, b.p as q, row_number() over (partition by a.source order by a.pos, b.pos) + 1.5::double as s
      from nm a join nm b on a.source = b.source and a.pos < b.pos), (select unnest([0, 1]) as d)""")
def e10_mat(spark, sf):
    return E.interaction_strengths(entries(spark, sf)["p_types"])


PROJ_SQL = f"""
{TARGET_SQL},
proj as materialized (select distinct atlas_region_id as source_brain_region_id, source as source_population_id, target_subregion_atlas_id as target_brain_region_id,
  target_projection_name as target_population_id, round(strength * region_prob, 9) as probability from lp
  where target_region_atlas_id is not null and strength * region_prob > 0
    and source in (select source from raw_targets group by 1 having count(*) > 1))
"""


def projections(spark, sf):
    e = entries(spark, sf)
    pops = populations(spark, sf, e)
    lp = E.layer_probabilities(targets(spark, sf, e, pops), pops, E.flatten_layer_profiles(e["layer_profiles"]))
    return E.projection_probabilities(lp, E.flatten_fractions(e["p_types"]), atlas_regions(spark, sf))


@shelf.add("e11_projection_probabilities", f"with recursive {PROJ_SQL} select source_brain_region_id, source_population_id, target_brain_region_id, target_population_id, {r6s('probability')} as probability from proj")
def e11(spark, sf):
    return projections(spark, sf).withColumn("probability", r6(F.col("probability")))


@shelf.add("e12_population_probabilities", f"""with recursive {TARGET_SQL}, pairs as (select distinct atlas_region_id as brain_region_id, pop_raw_name as population_id from pops)
    select brain_region_id, population_id, {r6s('1.0 / count(*) over (partition by brain_region_id)')} as probability from pairs""")
def e12(spark, sf):
    pairs = populations(spark, sf).select(F.col("atlas_region_id").alias("brain_region_id"), F.col("pop_raw_name").alias("population_id"))
    return E.population_probabilities(pairs).withColumn("probability", r6(F.col("probability")))


@shelf.add("e13_neuron_numbers", f"with recursive {VOL_SQL} select pop_raw_name, atlas_region_id, atlas_region_volume, greatest(trunc(atlas_region_volume * 0.00033)::bigint, 2) as pop_neuron_numbers from pops")
def e13(spark, sf):
    return E.neuron_numbers(populations(spark, sf), 0.00033)


@shelf.add("e14_projection_numbers", f"""with recursive {TARGET_SQL},
    nb as (select distinct pop_raw_name, atlas_region_volume, greatest(trunc(atlas_region_volume * 0.00033)::bigint, 2) as pop_neuron_numbers from pops)
    select t.source, t.sub_region, t.target_projection_name, nb.atlas_region_volume as atlas_region_volume_target, nb.pop_neuron_numbers
    from tflat t left join nb on nb.pop_raw_name = t.target_population_name""")
def e14(spark, sf):
    e = entries(spark, sf)
    pops = populations(spark, sf, e)
    return E.projection_numbers(E.flatten_projections(e["projections"], pops), E.neuron_numbers(pops, 0.00033)).select(
        "source", "sub_region", "target_projection_name", "atlas_region_volume_target", "pop_neuron_numbers")


# --- one-to-one probabilities: tufts are the event types of a user, axons their parity ----------

TUFT_SQL = f"""
{POINTS_SQL},
tuft_means as (select morphology, (point_id % 2)::integer as axon_id, event_type,
  avg(x) as common_ancestor_x, avg(y) as common_ancestor_y, avg(z) as common_ancestor_z from points group by 1, 2, 3),
tufts as (select *, row_number() over (partition by morphology order by event_type, axon_id) as tuft_id from tuft_means),
cells as (select distinct c_custkey::varchar as morphology from customer)
"""


def tufts(spark, sf):
    from pyspark.sql import Window

    base = points(spark, sf).groupBy("morphology", (F.col("point_id") % 2).cast("int").alias("axon_id"), "event_type").agg(
        *[F.avg(a).alias(f"common_ancestor_{a}") for a in "xyz"])
    w = Window.partitionBy("morphology").orderBy("event_type", "axon_id")  # at most ten rows a group
    return base.withColumn("tuft_id", F.row_number().over(w).cast("bigint"))


def cells(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("morphology")).distinct()


@shelf.add("e15_one_to_one_probabilities", f"""with {TUFT_SQL}
    select morphology, axon_id, tuft_id, morphology || '_' || axon_id as source_population_id,
      morphology || '_' || axon_id || '-' || tuft_id as target_population_id, {r6s('common_ancestor_x')} as target_x, 1.0::double as probability
    from tufts where morphology in (select morphology from cells)""")
def e15(spark, sf):
    _pops, proj = E.one_to_one_probabilities(cells(spark, sf), tufts(spark, sf))
    return proj.select("morphology", "axon_id", "tuft_id", "source_population_id", "target_population_id", r6(F.col("target_x")).alias("target_x"), "probability")


@shelf.add("e15_one_to_one_populations", f"""with {TUFT_SQL} select distinct morphology || '_' || axon_id as population_id, morphology || '_' || axon_id as brain_region_id, 1.0::double as probability from tufts""")
def e15_pops(spark, sf):
    pops, _ = E.one_to_one_probabilities(cells(spark, sf), tufts(spark, sf))
    return pops


@shelf.add("e16_source_regions", f"""with {TUFT_SQL} select morphology, morphology || '_' || min(axon_id) as source_brain_region_id from tufts
    where morphology in (select morphology from cells) group by 1""")
def e16(spark, sf):
    c = cells(spark, sf)
    _pops, proj = E.one_to_one_probabilities(c, tufts(spark, sf))
    kept, _missing = E.attach_source_regions(c, proj)
    return kept


@shelf.add("s09_recipe_documents", f"with recursive {TARGET_SQL} select source, count(*) as n_targets, {r6s('sum(target_density)', 2)} as density from raw_targets group by 1")
def s09(spark, sf):
    rows = entries(spark, sf)["projections"].select("source", F.explode("targets").alias("t"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_targets"), r6(F.sum("t.density"), 2).alias("density"))
