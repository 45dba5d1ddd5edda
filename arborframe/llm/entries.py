"""The numbered queries over the driver tables, each applying its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arborframe.llm import (
    backoff,
    decontaminate,
    fertility,
    fill_middle,
    hyperminhash,
    jaccard_regions,
    packing,
    pairwise_quality,
    runlength,
    secrets,
    sentence_toxicity,
    spelling,
    token_cache,
)
from arborframe.operators.core import scratch_path
from arborframe.plans.registry import Shelf
from arborframe.plans.views import table

shelf = Shelf()


def queries() -> dict:
    return dict(shelf.queries)


def oracles() -> dict:
    return dict(shelf.oracles)


@shelf.add("op1_pairwise_quality")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise_quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@shelf.add("op2_sentence_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@shelf.add("op3_best_fit_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@shelf.add("op5_stupid_backoff")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return backoff.scored(table(spark, sf, "documents"), order=3)


@shelf.add("op7_token_counts")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    rows = token_cache.token_counts(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        scratch_path(spark, "token-cache"),
    )
    return rows.withColumn("over_limit", rows["n_tokens"] > 512)


@shelf.add("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = fertility.measures(
        docs, public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("word_bpe_49k.json"), lang_col="lang",
    )
    return fertility.judged_by_corpus(rows)


@shelf.add("op4_secret_scan", secrets.oracle())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(table(spark, sf, "documents"))


@shelf.add("op6_decontamination", decontaminate.ORACLE)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontaminate.contamination(docs, items).drop("rid")


@shelf.add("op10_jaccard_join", jaccard_regions.ORACLE)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_regions.linked_components(table(spark, sf, "documents"))


@shelf.add("op9_run_length_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return runlength.digest(table(spark, sf, "documents"))


@shelf.add("op11_hyperminhash", hyperminhash.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))


@shelf.add("op12_fill_middle", fill_middle.ORACLE)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf, "documents"))


@shelf.add("op13_spelling_variants")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))
