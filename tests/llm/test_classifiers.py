"""The two classifiers: folds, samples, held-out accuracy, and the rows that carry nothing."""

import random
import zlib

import numpy as np
import pytest

from arborframe.llm import entries, pairwise_quality, sentence_toxicity
from arborframe.llm.labelled import held_out, sample

from . import messy

SF = "/root/testdata/sf0.01"


def test_folds(spark):
    ids = [(i,) for i in range(50)] + [(None,)]
    got = spark.createDataFrame(ids, "doc_id long").select("doc_id", held_out("doc_id", 3, 1))
    for doc, out in got.collect():
        assert out == (zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 1)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    rows = [(i, i % 2) for i in range(300)] + [(1, 0), (1, 1), (2, None), (None, 1), (4, 1), (4, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r["doc_id"]: r["y"] for r in sample(labels, "quality", 1000, parts=3, part=1).collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got) and None not in got
    assert got.get(2, 0) == 0 and got.get(4, 1) == 1  # two of three say 1
    assert sample(labels, "quality", 40, parts=3, part=1).count() == 40


def accuracy(spark, query, label):
    docs = query(spark, SF)
    assert docs.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = docs.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return np.mean([a == b for a, b in got])


def test_quality_on_the_held_out_fold(spark):
    assert accuracy(spark, entries.op1, "quality") > 0.97


def test_toxicity_on_the_held_out_fold(spark):
    assert accuracy(spark, entries.op2, "toxic") > 0.9


def test_pairwise_weights_order_the_classes():
    draw = np.random.default_rng(1)
    y = (draw.random(600) > 0.2).astype(int)
    x = draw.normal(size=(600, 4))
    x[:, 2] += 3 * y
    model = pairwise_quality.fit(x, y, pairs=2000)
    assert abs(model.weights[2]) > 3 * np.abs(np.delete(model.weights, 2)).max()
    # the threshold is the quantile at the share of bad rows
    assert abs((model.score(x) < 0.5).mean() - (y == 0).mean()) < 0.01
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize("given", [[], [(0, 1), (2, 1), (3, 1), (5, 1)]])
def test_no_or_one_class(spark, given):
    docs = messy.table(spark)
    quality = spark.createDataFrame(given, "doc_id long, quality int")
    got = pairwise_quality.judged(docs, quality).collect()
    assert len(got) == len(messy.texts()) and {r["score"] for r in got} == {0.5}
    toxic = spark.createDataFrame(given, "doc_id long, toxic int")
    got = sentence_toxicity.judged(docs, toxic).collect()
    assert len(got) == len(messy.texts())
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["sentences"] for r in got if r["score"] < 0.1)


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert pairwise_quality.judged(messy.empty(spark), labels).count() == 0
    assert sentence_toxicity.judged(messy.empty(spark), labels).count() == 0


def toxic_corpus(draw, n=400):
    rows, labels = [], []
    for i in range(n):
        parts = [messy.sentence(draw, draw.randint(3, 8)) for _ in range(draw.randint(1, 12))]
        bad = draw.random() < 0.3
        if bad:
            at = draw.randrange(len(parts))
            words = parts[at].split()
            words[0] = draw.choice(["Grobnik", "grobnika", "snarfel!", "snarfelei"])
            parts[at] = " ".join(words)
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_offending_sentences_are_located(spark):
    rows, labels = toxic_corpus(random.Random(8))
    docs = messy.table(spark, rows + [(900, None), (901, ""), (None, "grobnik you")])
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in sentence_toxicity.judged(docs, labels).collect()}
    assert got[900]["score"] == got[901]["score"] == 0 and got[None]["n_offending"] == 1
    right = found = 0
    for doc, text in rows:
        spans = [text[s["start"] : s["end"]].lower() for s in got[doc]["sentences"]]
        bad = [p for p in text.lower().replace("!", ".").split(".") if "grobnik" in p or "snarfel" in p]
        right += (got[doc]["predicted"] == 1) == bool(bad)
        found += all("grobnik" in s or "snarfel" in s for s in spans) and bool(spans) == bool(bad)
    assert right / len(rows) > 0.97 and found / len(rows) > 0.95


def test_long_labelled_texts_are_skipped(spark):
    rows, labels = toxic_corpus(random.Random(4), 60)
    long_ = [(1000 + i, "grobnik " * 20_000) for i in range(60)]
    schema = "doc_id long, toxic int"
    given = spark.createDataFrame(labels, schema)
    more = spark.createDataFrame(labels + [(i, 1) for i, _ in long_], schema)
    want = sentence_toxicity.learn(messy.table(spark, rows), given, most_words=19_000)
    got = sentence_toxicity.learn(messy.table(spark, rows + long_), more, most_words=19_000)
    assert want.weights.any() and np.array_equal(got.weights, want.weights) and got.bias == want.bias
    clean = spark.createDataFrame([(i, 0) for i, y in labels if not y], schema)
    only = clean.unionByName(more.filter("doc_id >= 1000"))
    docs = messy.table(spark, rows + long_)
    assert not sentence_toxicity.learn(docs, only, most_words=19_000).weights.any()
    # with a bound for each document the long ones take part by some of their sentences
    assert sentence_toxicity.learn(docs, only, most_words=19_000, doc_words=150).weights.any()


def test_sentences_of_long_texts():
    text = ". ".join(f"s{i} of five words here" for i in range(100))
    every = sentence_toxicity.some_sentences(text, 10_000)
    assert len(every) == 100 and all(len(s) == 5 for s in every)
    some = sentence_toxicity.some_sentences(text, 52)
    assert len(some) == 10 and all(s in every for s in some) and some != every[:10]
    assert sentence_toxicity.some_sentences("a b c d", 2) == [["a", "b"]]
    assert sentence_toxicity.some_sentences(". !\n", 2) == []


def plain_chance(text, model):
    """Noisy-or by hand: sentences without words do not count."""
    none = 1.0
    for sentence in sentence_toxicity.BREAK.split(text or ""):
        words = sentence.lower().split()
        if words:
            z = model.bias + sum(
                float(model.weights.astype(np.float32)[sentence_toxicity.slots(sentence_toxicity.bare(w))].sum())
                for w in words
            )
            none *= 1 - 1 / (1 + np.exp(-z))
    return 1 - none


def test_scores_are_noisy_or(spark):
    rows, labels = toxic_corpus(random.Random(12), 80)
    docs = messy.table(spark, rows + messy.texts())
    model = sentence_toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sentence_toxicity.scored(docs, model).select("doc_id", "score").collect()
    want = [(d, plain_chance(t, model)) for d, t in rows + messy.texts()]
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 4))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4


def test_features_of_extremes():
    for text in (None, "", " ", "x" * 100_000, "\x00", "é🙂" * 50):
        values = pairwise_quality.features(text)
        assert len(values) == pairwise_quality.N_FEATURES and np.isfinite(values).all()


def test_scored_keeps_all_columns(spark):
    model = pairwise_quality.fit(np.zeros((0, 0)), np.zeros(0))
    docs = messy.table(spark)
    got = pairwise_quality.scored(docs, model, into="score")
    assert got.columns == docs.columns
    assert [r["score"] for r in got.collect()] == [0.5] * len(messy.texts())
