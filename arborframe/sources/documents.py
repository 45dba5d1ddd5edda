"""Nested JSON documents: region hierarchies and connectivity recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.operators.core import written

POPULATION = (
    "struct<name:string,atlas_region:array<struct<name:string,subregions:array<string>>>,"
    "filters:map<string,string>>"
)
TARGET = (
    "struct<population:string,projection_name:string,density:double,hemisphere:string,"
    "presynaptic_mapping:struct<base_system:string,x:array<double>,y:array<double>,mapping_variance:double>,"
    "target_layer_profiles:array<struct<name:string,fraction:double>>,"
    "synapse_types:array<struct<name:string,fraction:double>>>"
)
PROJECTION = f"struct<source:string,targets:array<{TARGET}>>"
LAYER_PROFILE = "struct<name:string,relative_densities:array<struct<layers:array<string>,value:double>>>"
P_TYPE = (
    "struct<population:string,fractions:map<string,double>,"
    "interaction_mat:struct<projections:array<string>,strengths:array<double>>>"
)
RECIPE = (
    f"struct<populations:array<{POPULATION}>,projections:array<{PROJECTION}>,"
    f"layer_profiles:array<{LAYER_PROFILE}>,`p-types`:array<{P_TYPE}>>"
)


def read_recipe(documents: DataFrame, body: str = "body") -> dict[str, DataFrame]:
    """Entry tables of recipe documents given as JSON text, one document per row.

    An ``atlas_region`` may be one object or a list of objects; both become a list.
    """
    raw = documents.select(F.parse_json(body).alias("_v"))
    parsed = documents.select(F.from_json(body, RECIPE).alias("_d"))

    def entries(field: str) -> DataFrame:
        return parsed.select(F.explode(F.col(f"_d.`{field}`")).alias("_e")).select("_e.*")

    pops = raw.select(
        F.explode(F.expr("try_variant_get(_v, '$.populations', 'array<variant>')")).alias("_p")
    )
    region = "array<struct<name:string,subregions:array<string>>>"
    single = "struct<name:string,subregions:array<string>>"
    populations = pops.select(
        F.expr("variant_get(_p, '$.name', 'string')").alias("name"),
        F.coalesce(
            F.expr(f"try_variant_get(_p, '$.atlas_region', '{region}')"),
            F.array(F.expr(f"try_variant_get(_p, '$.atlas_region', '{single}')")),
        ).alias("atlas_region"),
        F.expr("try_variant_get(_p, '$.filters', 'map<string,string>')").alias("filters"),
    )
    return {
        "populations": populations,
        "projections": entries("projections"),
        "layer_profiles": entries("layer_profiles"),
        "p_types": entries("p-types"),
    }


def read_hierarchy(documents: DataFrame, body: str = "body") -> DataFrame:
    """Rows (id, parent_id, acronym, name, st_level) of nested region documents.

    Each document is one nested ``{id, acronym, name, children: [...]}`` object of any depth;
    every round unpacks one level of all documents.
    """
    node = "struct<id:bigint,acronym:string,name:string>"
    level = documents.select(F.parse_json(body).alias("_v"), F.lit(-1).cast("bigint").alias("parent_id"))
    found: list[DataFrame] = []
    depth = 0
    while True:
        unpacked = level.select(
            F.expr(f"variant_get(_v, '$', '{node}')").alias("_n"), "parent_id",
            F.expr("try_variant_get(_v, '$.children', 'array<variant>')").alias("_kids"),
        ).select("_n.*", "parent_id", F.transform("_kids", lambda k: k.cast("string")).alias("_kids"))
        kept = written(unpacked, f"hierarchy-{depth}")
        found.append(kept.select("id", "parent_id", "acronym", "name", F.lit(depth).alias("st_level")))
        below = kept.filter(F.size("_kids") > 0)
        if below.limit(1).count() == 0:
            break
        level = below.select(
            F.explode("_kids").alias("_text"), F.col("id").alias("parent_id")
        ).select(F.parse_json("_text").alias("_v"), "parent_id")
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
