"""A corpus pipeline in stages; each works on all documents that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``, with ``docs`` shaped like ``documents``, and returns
such rows; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.llm import decontaminate, jaccard_regions, packing, pairwise_quality, secrets
from arborframe.operators.core import written
from arborframe.plans.views import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its threshold.

    NULL and empty texts have the features of the empty text and go or stay by their score; rows
    without an id are scored like others.  Repeated rows have one score and stay or go together;
    all columns are kept.  Without labels every score is 0.5 and all documents stay.
    """
    model = pairwise_quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = pairwise_quality.scored(docs, model, into="_quality")
    return scored.filter(F.col("_quality") >= 0.5).drop("_quality")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near duplicates; of a repeated row, one.

    Documents without words and rows without an id stay, equal ones of them once.  Of rows with
    one id and text that differ in other columns, any one stays.
    """
    found = jaccard_regions.linked_components(docs.select("doc_id", "text"))
    later = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(written(later, "near-copies"), "doc_id", "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in passages of the benchmark.

    Documents without words stay, NULL texts among them, and so do all where the benchmark is
    empty; rows without an id are judged like others, repeated rows together; all columns are kept.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret.

    NULL texts stay NULL, empty ones empty; every row comes back with all its columns, repeated
    ones as often as they were given; ``n_chars`` follows the new text.
    """
    out = secrets.redacted(secrets.scan(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences.

    NULL and empty texts are one piece of the end id; repeated rows are packed as often as they
    were given, rows without an id with a NULL one; other columns are not returned.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
