"""The pipeline's stages, each against a plain version over its own input."""

import random
import re

import corpus_pipeline
from arborframe.llm import pairwise_quality
from arborframe.operators.core import written
from arborframe.plans.views import table

from . import messy
from .test_corpus import plain_components
from .test_native import BASE, plain_contamination

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans",
        "best-fit packing",
    ]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    kept = [written(docs, "stage")]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "stage"))
    for df in kept[:-1]:
        assert df.columns == columns
    rows = [sorted(tuple(r) for r in df.select("doc_id", "text").collect()) for df in kept[:-1]]
    judged = pairwise_quality.judged(docs, table(spark, SF, "labels")).filter("predicted = 1")
    assert [r[0] for r in rows[1]] == ids(judged)
    assert [r[0] for r in rows[2]] == sorted(d for d, _, c in plain_components(rows[1]) if d == c)
    bad = {r[0] for r in plain_contamination(rows[2], items) if r[5]}
    assert rows[3] == [r for r in rows[2] if r[0] not in bad] and bad
    assert [r[0] for r in rows[4]] == [r[0] for r in rows[3]]
    for (_, before), (_, after) in zip(rows[3], rows[4]):
        secret = any(
            len(m[g]) >= least for _, p, g, least in BASE for m in p.finditer(before)
        )
        assert ("[SECRET]" in after) if secret else before == after
        assert not re.search("[0-9a-f]{24}", after)
    pieces = kept[-1]
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in rows[4]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, pieces.drop("sequence_id", "offset").collect())
    )


def test_messy_documents(spark, tmp_path):
    draw = random.Random(2)
    rows = messy.texts() + [(700 + i, messy.sentence(draw, 80)) for i in range(40)]
    docs = messy.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "row", "rid")
    labels = [(d, i % 2) for i, (d, _) in enumerate(rows) if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(rows[-1][1].split()[:20])), (None, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
        if "piece" not in docs.columns:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "rid"]
    left = {r[0] for r in docs.collect()}
    assert rows[-1][0] not in left and {50, 51, 52, None} <= left and 41 not in left


def test_empty_documents(spark):
    docs = messy.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
