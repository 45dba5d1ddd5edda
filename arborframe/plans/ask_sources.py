"""Queries that write driver tables in each supported layout and read them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from arborframe.operators import batches as B
from arborframe.operators.core import dealt, regroup, scratch_path, written
from arborframe.plans.ask_sampling import SEED_SQL
from arborframe.plans.ask_voxels import GRID, CLOSURE
from arborframe.plans.registry import Shelf
from arborframe.plans.views import (
    HIERARCHY_SQL, POINTS_SQL, VOXELS_SQL, hierarchy, points, r6, r6s, table, voxels,
)
from arborframe.sources import documents as X
from arborframe.sources import morphologies as N
from arborframe.sources import tables as K

shelf = Shelf()
M = "morphology"


@shelf.add("s01_listed_files", """select user_id::varchar as morphology, '.parquet' as suffix from events group by 1""")
def s01(spark, sf):
    path = scratch_path(spark, "listing")
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user"), F.lit(1).alias("one")).distinct()
    dealt(users, ["user"]).write.partitionBy("user").parquet(path)
    files = N.list_files(spark, path, suffixes=[".parquet"])
    return files.select(F.regexp_extract(M, r"user=([^/]+)/", 1).alias(M), "suffix").distinct()


@shelf.add("s02_point_tables", f"""with {POINTS_SQL} select morphology, point_id, case when parent_id = -1 then 1 else type end as type, {r6s('x')} as x, {r6s('radius')} as radius, parent_id from points""")
def s02(spark, sf):
    path = scratch_path(spark, "swc")
    pts = points(spark, sf).withColumn("type", F.when(F.col("parent_id") == -1, F.lit(1)).otherwise(F.col("type")))
    note = F.when(F.col("point_id") == 2, F.lit("   # second point")).otherwise(F.lit(""))
    row = F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in N.POINT_COLUMNS]), note)
    text = pts.select(M, row.alias("value")).unionByName(
        pts.filter("point_id = 1").select(M, F.lit("# index type X Y Z radius parent").alias("value")))
    dealt(text, [M]).write.partitionBy(M).option("compression", "none").text(path)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    named = N.parse_points(lines).withColumn(M, F.regexp_extract("file", r"morphology=([^/]+)/", 1))
    return named.select(M, "point_id", "type", r6(F.col("x")).alias("x"), r6(F.col("radius")).alias("radius"), "parent_id")


@shelf.add("s03_csv_with_json", """select conv_id, count(*) as n_turns, sum(length(text))::bigint as n_chars, min(role) as first_role from conversations group by 1""")
def s03(spark, sf):
    path = scratch_path(spark, "csv")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    K.write_csv(turns, path, json_columns=["turns"])
    back = K.read_csv(spark, path, "conv_id bigint, turns string", json_columns={"turns": "array<struct<turn:bigint,role:string,text:string>>"})
    t = back.select("conv_id", F.explode("turns").alias("t"))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("t.text")).alias("n_chars"), F.min("t.role").alias("first_role"))


@shelf.add("s04_json_records", "select vec_id, label, round(embedding[1]::double, 6) + 0.0 as first, len(embedding)::integer as n from embeddings")
def s04(spark, sf):
    path = scratch_path(spark, "json")
    K.write_records(table(spark, sf, "embeddings"), path)
    back = K.read_records(spark, path, "vec_id bigint, embedding array<float>, label int")
    return back.select("vec_id", "label", r6(F.col("embedding")[0].cast("double")).alias("first"), F.size("embedding").alias("n"))


@shelf.add("s05_checked_probabilities", f"""select 'population' as kind, s_name as name, s_nationkey::varchar as region, {r6s("s_acctbal / 10000")} as value from supplier
    union all select 'projection', s_name, n_nationkey::varchar, {r6s("(s_suppkey % 10) / 10.0::double")} from supplier join nation on n_regionkey = s_nationkey % 5
    union all select 'tuft number', c_name, null, {r6s("c_acctbal")} from customer
    union all select 'bad tuft number', c_name, null, {r6s("c_acctbal")} from customer where c_acctbal <= 0""")
def s05(spark, sf):
    """The three probability tables, written to a folder and read back from it with their checks."""
    folder = scratch_path(spark, "probabilities")
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    pops = supplier.select(F.col("s_name").alias("population_id"), F.col("s_nationkey").cast("string").alias("brain_region_id"), (F.col("s_acctbal") / 10000).alias("probability"))
    into = supplier.join(nation, F.col("n_regionkey") == F.col("s_nationkey") % 5).select(
        F.col("s_name").alias("source_population_id"), F.col("s_nationkey").cast("string").alias("source_brain_region_id"), F.col("n_name").alias("target_population_id"),
        F.col("n_nationkey").cast("string").alias("target_brain_region_id"), (F.col("s_suppkey") % 10 / 10.0).alias("probability"))
    numbers = table(spark, sf, "customer").select(F.col("c_name").alias("target_population_id"), F.col("c_acctbal").alias("mean_tuft_number"), F.lit(1.0).alias("std_tuft_number"))
    K.write_probabilities(folder, populations=pops, projections=into, tuft_numbers=numbers)
    read, bad = K.load_probabilities(spark, folder)

    def rows(df, kind, name, region, value):
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), region.cast("string").alias("region"), r6(F.col(value)).alias("value"))

    none = F.lit(None)
    return (
        rows(read["populations"], "population", "population_id", F.col("brain_region_id"), "probability")
        .unionByName(rows(read["projections"], "projection", "source_population_id", F.col("target_brain_region_id"), "probability"))
        .unionByName(rows(read["tuft_numbers"], "tuft number", "target_population_id", none, "mean_tuft_number"))
        .unionByName(rows(bad, "bad tuft number", "target_population_id", none, "mean_tuft_number"))
    )


@shelf.add("s06_keyed_tables", "select o_custkey::varchar as morphology, o_orderkey, case when o_orderstatus = 'F' then o_orderkey else -1 end as grafting_section_id from orders")
def s06(spark, sf):
    path = scratch_path(spark, "grafting")
    o = table(spark, sf, "orders")
    o.select(F.col("o_custkey").cast("string").alias(M), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("double")).alias("grafting_section_id")).write.parquet(path)
    return K.read_keyed(spark, path, required=[M, "grafting_section_id"], section_column="grafting_section_id")


@shelf.add("s07_voxel_volume", f"with {VOXELS_SQL} select i, j, k, region_id, 10.0::double as dim_x from voxels")
def s07(spark, sf):
    path = scratch_path(spark, "volume")
    K.save_volume(voxels(spark, sf), GRID, path)
    back, grid = K.load_volume(spark, path)
    return back.select("i", "j", "k", "region_id", F.lit(grid.dim[0]).alias("dim_x"))


def region_documents(spark, sf):
    """One nested JSON document per region: the nations and their customers as children."""
    h = hierarchy(spark, sf)
    leaf = h.filter("id >= 1000").select(F.col("parent_id").alias("id"), F.to_json(F.struct("id", "acronym", "name")).alias("node"))
    kids = leaf.groupBy("id").agg(F.concat_ws(",", F.array_sort(F.collect_list("node"))).alias("kids"))

    def node(df):
        head = F.to_json(F.struct("id", "acronym", "name"))
        df = df.withColumn("_head", head)
        body = F.concat(
            F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"children":['),
            F.coalesce("kids", F.lit("")), F.lit("]}"))
        return df.select("parent_id", body.alias("node"))

    nations = node(h.filter("id between 100 and 999").join(kids, "id", "left"))
    per = nations.groupBy(F.col("parent_id").alias("id")).agg(F.concat_ws(",", F.array_sort(F.collect_list("node"))).alias("kids"))
    return node(h.filter("id between 10 and 99").join(per, "id", "left")).select(F.col("node").alias("body"))


@shelf.add("s08_region_documents", f"""with recursive {CLOSURE} select h.id, case when h.parent_id = 1 then -1 else h.parent_id end as parent_id, acronym, name, st_level - 1 as st_level from hierarchy h join levels using (id) where h.id > 1""")
def s08(spark, sf):
    return X.read_hierarchy(written(region_documents(spark, sf), "region-documents"))


@shelf.add("s10_attached_files", """with u as (select distinct user_id from events), f as (select c_custkey from customer where c_custkey in (select user_id from u))
    select user_id::varchar as morphology, case when c_mktsegment in ('BUILDING', 'MACHINERY') then '.swc' when c_mktsegment = 'HOUSEHOLD' then '.asc' else 'none' end as suffix
    from u left join customer on c_custkey = user_id""")
def s10(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias(M)).distinct()
    seg = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias(M), "c_mktsegment")
    have = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit(".swc"), F.lit(".asc"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit(".h5"), F.lit(".swc"))).when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit(".asc")))
    files = seg.select(M, F.explode(have).alias("suffix")).withColumn("path", F.concat(F.lit("/data/"), F.col(M), F.col("suffix")))
    found, missing = N.attach_files(users, files)
    return found.select(M, F.regexp_extract("morph_file", r"(\.[^./]*)$", 1).alias("suffix")).unionByName(missing.select(M, F.lit("none").alias("suffix")))


@shelf.add("s11_exported_edges", f"""with {POINTS_SQL} select p.morphology::integer as morphology, p.point_id as target, {r6s('p.x')} as x_to, {r6s('q.x')} as x_from, p.type as neurite_type from points p join points q on q.morphology = p.morphology and q.point_id = p.parent_id where p.type in (2, 3)""")
def s11(spark, sf):
    path = scratch_path(spark, "edges")
    N.export_edges(written(points(spark, sf), "points"), path, types=[2, 3])
    schema = "target bigint, source bigint, x_from double, y_from double, z_from double, radius_from double, is_terminal_from boolean, section_id_from bigint, sub_segment_num_from bigint, x_to double, y_to double, z_to double, radius_to double, is_terminal_to boolean, section_id_to bigint, sub_segment_num_to bigint, neurite_type int, morphology int"
    back = spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)
    return back.select(M, "target", r6(F.col("x_to")).alias("x_to"), r6(F.col("x_from")).alias("x_from"), "neurite_type")


@shelf.add("s12_appended_clusters", "select c_name as morphology, c_mktsegment as config_name from customer")
def s12(spark, sf):
    path = scratch_path(spark, "append")
    c = table(spark, sf, "customer").select(F.col("c_name").alias(M), F.col("c_mktsegment").alias("config_name"))
    K.append(c.filter("config_name <> 'BUILDING'"), path, keys=[M])
    K.append(c, path, keys=[M])
    return spark.read.parquet(path)


@shelf.add("s13_reused_result", "select p_brand, count(*) as n from part group by 1")
def s13(spark, sf):
    path = scratch_path(spark, "reuse")
    make = lambda: table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    K.reuse(spark, path, make)

    def never():
        raise AssertionError("the table was there already")

    return K.reuse(spark, path, never)


@shelf.add("s14_cell_collection", f"""with {POINTS_SQL}, o as (select morphology, x, sha256(morphology) as h from points where parent_id = -1)
    select row_number() over (order by morphology) as index, morphology, 0.0::double as x, {r6s('x')} as atlas_x, {SEED_SQL} as seed, 'default' as mtype from o""")
def s14(spark, sf):
    pts = points(spark, sf).withColumn("type", F.when(F.col("parent_id") == -1, F.lit(1)).otherwise(F.col("type")))
    return N.cell_collection(pts).select("index", M, "x", r6(F.col("atlas_x")).alias("atlas_x"), "seed", "mtype")


# --- execution helpers ----------------------------------------------------------------------------


@shelf.add("i02_grouped_partitions", "select o_custkey, 1::bigint as n_partitions, count(*) as n_rows from orders group by 1")
def i02(spark, sf):
    rows = regroup(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"]).withColumn("_p", F.spark_partition_id())
    return rows.groupBy("o_custkey").agg(F.count_distinct("_p").alias("n_partitions"), F.count(F.lit(1)).alias("n_rows"))


@shelf.add("i03_applied_function", f"select p_partkey, {r6s('sqrt(p_retailprice)')} as root, p_size * 2 as twice from part")
def i03(spark, sf):
    rows = B.with_columns(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), {"twice": F.col("p_size") * 2})
    out = B.apply_rows(rows, lambda d: d.assign(root=d["p_retailprice"] ** 0.5), {"root": "double"})
    return out.select("p_partkey", r6(F.col("root")).alias("root"), "twice")


@shelf.add("i04_isolated_failures", """select c_nationkey, count(*) filter (c_acctbal >= 0) as n_good, count(*) filter (c_acctbal < 0) as n_failed, max(case when c_acctbal < 0 then 'ValueError: negative balance' end) as error from customer group by 1""")
def i04(spark, sf):
    def check(batch):
        if (batch["c_acctbal"] < 0).any():
            raise ValueError("negative balance")
        return batch.assign(level=batch["c_acctbal"])

    out = B.apply_rows(table(spark, sf, "customer").select("c_nationkey", "c_acctbal"), check, {"level": "double"})
    return out.groupBy("c_nationkey").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n_good"), F.count("error").alias("n_failed"), F.max("error").alias("error"))


# The lines of an order are a handful; an order with a full line at full discount fails as a whole.
_ORDER_SQL = """orders_of as materialized (select l_orderkey, median(l_extendedprice) as median_price, max(l_extendedprice) - min(l_extendedprice) as price_range,
    bool_or(l_discount >= 0.1 and l_quantity >= 50) as failed, count(*) as n_lines from lineitem group by 1)"""


def order_results(spark, sf):
    def prices(lines):
        if ((lines["l_discount"] >= 0.1) & (lines["l_quantity"] >= 50)).any():
            raise ValueError("full discount")
        price = lines.groupby("l_orderkey", sort=False)["l_extendedprice"]
        made = pd.DataFrame({"median_price": price.median(), "price_range": price.max() - price.min()})
        return made.reset_index()

    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity")])
    return lines, B.apply_groups(lines, ["l_orderkey"], prices, {"median_price": "double", "price_range": "double"})


@shelf.add("i03_applied_group_function", f"""with {_ORDER_SQL} select l_orderkey, {r6s("case when not failed then median_price end")} as median_price,
    {r6s("case when not failed then price_range end")} as price_range, case when failed then 'ValueError: full discount' end as error from orders_of""")
def i03_groups(spark, sf):
    made = order_results(spark, sf)[1]
    return made.select("l_orderkey", r6(F.col("median_price")).alias("median_price"), r6(F.col("price_range")).alias("price_range"), "error")


@shelf.add("i04_failed_groups", f"""with {_ORDER_SQL} select l_orderkey, case when failed then 'failed' else 'kept' end as outcome, n_lines, case when failed then 'ValueError: full discount' end as error from orders_of""")
def i04_groups(spark, sf):
    """Lines of the orders that worked, and the orders that did not with their messages."""
    lines, made = order_results(spark, sf)
    marked = written(lines.join(made.select("l_orderkey", "error"), "l_orderkey"), "order-lines")
    count = F.count(F.lit(1)).alias("n_lines")
    kept = B.drop_failed_groups(marked, ["l_orderkey"]).groupBy("l_orderkey").agg(count).select(
        "l_orderkey", F.lit("kept").alias("outcome"), "n_lines", F.lit(None).cast("string").alias("error"))
    failed = B.failed_groups(marked, ["l_orderkey"]).join(marked.groupBy("l_orderkey").agg(count), "l_orderkey")
    return kept.unionByName(failed.select("l_orderkey", F.lit("failed").alias("outcome"), "n_lines", "error"))
