"""Labelled rows for the classifiers: folds by a digest of the id, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder that is kept for testing."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(text) % parts) == part


def sample(
    labels: DataFrame, label: str, most: int, *, parts: int, part: int, id_col: str = "doc_id",
) -> DataFrame:
    """Rows ``doc_id, y``: at most ``most`` labelled ids outside the held-out fold.

    Ids are taken in the order of a hash, so the sample does not follow ids or places.  Repeated
    labels of an id are averaged; NULL labels, NULL ids and ties between 0 and 1 are left out.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull()
    )
    known = known.filter(~held_out("doc_id", parts, part))
    voted = known.groupBy("doc_id").agg(F.avg("y").alias("y")).filter(F.col("y") != 0.5)
    return (
        voted.select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
