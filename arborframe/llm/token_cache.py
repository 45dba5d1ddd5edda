"""Token counts from a cache of digests: only contents never counted before are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.llm.encoding import encoder, version_digest
from arborframe.sources.tables import exists

STORED = "version string, digest binary, n_bytes long, n_tokens long"


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        texts = batch.column(1)
        counts = [len(enc.ids(texts[i].as_py())) // 4 for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
            names=["digest", "n_bytes", "n_tokens"],
        )


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens`` for every row of ``docs``, through the cache folder.

    The key of a count is the SHA-256 of the content and that of the tokenizer file.  The content
    is normalised only where the tokenizer ignores the difference: NULL counts as empty, nothing
    else is changed.  Distinct contents without a stored count are encoded once and appended.
    A job runs while the plan is built.  NULL ids stay, repeated rows stay, copies share a count;
    an empty table gives an empty result.  Counts that two writers appended are the same and
    count once.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    misses = keyed
    if exists(spark, cache):
        stored = spark.read.schema(STORED).parquet(cache).filter(F.col("version") == version)
        misses = keyed.join(stored.select("digest"), "digest", "left_anti")
    # the aggregate drops copies before and after the shuffle, so a hot content is sent once a task
    distinct = misses.groupBy("digest").agg(
        F.first("text").alias("text"), F.first("n_bytes").alias("n_bytes")
    )
    made = distinct.mapInArrow(
        lambda batches: _encode(batches, tokenizer), "digest binary, n_bytes long, n_tokens long"
    )
    made.select(F.lit(version).alias("version"), "digest", "n_bytes", "n_tokens").write.mode(
        "append"
    ).parquet(cache)
    counts = (
        spark.read.schema(STORED).parquet(cache).filter(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))
    )
    # joined on the length too, so that both sides are dealt anew and a hot digest can be split
    return keyed.select("doc_id", "digest", "n_bytes").join(
        counts, ["digest", "n_bytes"], "left"
    ).select("doc_id", "n_bytes", "n_tokens")
