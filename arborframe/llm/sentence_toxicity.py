"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is toxic with the logistic of its words' weights; a document is toxic unless none of
its sentences is (noisy-or).  The weights are trained from document labels alone, and the
sentence scores then tell where a document offends.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.llm.encoding import Known
from arborframe.llm.labelled import held_out, sample
from arborframe.operators.core import Scratch

BREAK = re.compile(r"[.!?\n]")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SLOTS = 1 << 17
SCORED = "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>"


#: A word counts by itself and by its beginnings of these lengths, for inflected forms.
STEMS = (4, 5, 6)


def bare(word: str) -> str:
    return word.strip(MARKS)


def slots(word: str) -> list[int]:
    """The weight slots of a bare word; the empty word has slot 0, whose weight stays 0."""
    names = [f"{k}:{word[:k]}" if len(word) >= k else "" for k in STEMS]
    return [1 + zlib.crc32(x.encode()) % (SLOTS - 1) if x else 0 for x in (word, *names)]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def fit(
    docs: list[np.ndarray], y: np.ndarray, words: list[str], *, rounds: int = 200,
    rate: float = 0.1, bias: float = -7.0, decay: float = 2e-5,
) -> Model:
    """Noisy-or likelihood of document labels, by Adam over all given documents at once.

    ``docs`` holds the places in ``words`` of each document's words, every sentence closed by -1.
    With one class only, all weights stay 0 and every sentence has the chance given by ``bias``.
    """
    weights = np.zeros(SLOTS)
    if not len(docs) or y.min() == y.max():
        return Model(weights, bias)
    flat = np.concatenate(docs)
    ends = flat < 0
    sentence = np.cumsum(ends) - ends
    owner = np.repeat(np.arange(len(docs)), [int((d < 0).sum()) for d in docs])
    term, place, n = flat[~ends], sentence[~ends].astype(np.int32), int(ends.sum())
    parts = np.array([slots(w) for w in words])
    used, part = np.unique(parts, return_inverse=True)
    part = part.reshape(parts.shape)
    free = used > 0
    w, b = np.zeros(len(used)), bias
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(place, weights=w[part].sum(axis=1)[term], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.bincount(owner, weights=-softplus(z), minlength=len(docs))  # log of no toxic one
        odds = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y[owner] == 1, -p * odds[owner], p) / len(docs)
        by_word = np.bincount(term, weights=pull[place], minlength=len(words))
        by_part = np.bincount(part.ravel(), np.repeat(by_word, part.shape[1]), len(used))
        slope = np.append((by_part + decay * np.sign(w)) * free, pull.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        step = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-6)
        w, b = w - step[:-1], b - float(step[-1]) * 0.1
    weights[used] = w
    return Model(weights, b)


def learn(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = 8_000,
    parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text",
    most_words: int = 4_000_000, doc_words: int = 40_000,
) -> Model:
    """Fit on at most ``most`` labelled documents, the bounded sample that reaches the driver.

    A document of more than ``doc_words`` words takes part with the sentences of smallest hash
    that have so many.  The documents come in the order of their ids' hash; one that does not fit
    what is left of ``most_words`` words is passed over.  Only sizes are ordered; the words that
    are fetched are those that were chosen.
    """
    chosen = F.broadcast(sample(labels, label, most, parts=parts, part=part))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        chosen, "doc_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, packed, sizes = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                seen: dict[str, int] = {}
                out = array("i")
                for words in some_sentences((texts[i].as_py() or "").lower(), doc_words):
                    out.extend([seen.setdefault(bare(w), len(seen)) for w in words])
                    out.append(-1)
                lists.append(" ".join(seen))
                packed.append(out.tobytes())
                sizes.append(len(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lists, pa.string()),
                 pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "y", "words", "places", "size"],
            )

    made = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(
        run, "doc_id long, y int, words string, places binary, size long"
    )
    scratch = Scratch(docs.sparkSession)
    made = scratch.written(made.withColumn("rid", F.xxhash64("doc_id", "y", "words", "places")), "labelled-words")
    sizes = made.select("rid", "doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id", "rid").limit(most).collect()
    wanted, n = [], 0
    for row in sizes:
        if n + row["size"] <= most_words:
            n += row["size"]
            wanted.append(row["rid"])
    few = docs.sparkSession.createDataFrame([(r,) for r in sorted(set(wanted))], "rid long")
    fetched = made.join(F.broadcast(few), "rid", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "rid")
    taken, y, vocabulary = [], [], {}
    for row in fetched.toLocalIterator():
        places = np.frombuffer(row["places"], np.int32)
        if len(places):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in row["words"].split(" ")]
            taken.append(np.append(np.array(ids, np.int32), np.int32(-1))[places])
            y.append(row["y"])
    scratch.clear()
    return fit(taken, np.array(y, dtype=np.int64), list(vocabulary))


def some_sentences(text: str, most: int) -> list[list[str]]:
    """The words of all sentences; of more than ``most`` words, those of the sentences of smallest
    hash, and of a sentence that alone has more, its first ones."""
    every = [words for s in BREAK.split(text) if (words := s.split())]
    if sum(map(len, every)) <= most:
        return every
    out, left = [], most
    for words in sorted(every, key=lambda w: zlib.crc32(" ".join(w).encode())):
        if len(words) <= left or not out:
            out.append(words[:left])
            left -= len(out[-1])
    return out


def scored(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
    offends: float = 0.5,
) -> DataFrame:
    """Rows ``doc_id, score, sentences``: the document's chance, and its offending sentences.

    Sentences are spans of code points, end exclusive, with a chance of at least ``offends``.
    NULL and empty texts have no sentence and the score 0.  Repeated rows stay.
    """
    weights, bias = model.weights.astype(np.float32), float(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(lambda w: float(weights[slots(bare(w))].sum()), 300_000)
        for batch in batches:
            texts, scores, found = batch.column(1), [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                none, at, own = 0.0, 0, []
                for sentence in BREAK.split(text):
                    words = sentence.lower().split()
                    if words:
                        z = bias + sum([known[w] for w in words])
                        if z > -30:
                            none -= math.log1p(math.exp(z)) if z < 30 else z
                            chance = 1 / (1 + math.exp(-z)) if z < 30 else 1.0
                            if chance >= offends:
                                own.append({"start": at, "end": at + len(sentence), "score": chance})
                    at += len(sentence) + 1
                scores.append(-math.expm1(none))
                found.append(own)
            spans = pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, spans)],
                names=["doc_id", "score", "sentences"],
            )

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, SCORED)


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted, n_offending, sentences`` for every document.

    NULL and empty texts score 0; a NULL id counts as an empty one in ``held_out``.  Repeated rows come back as
    often as they were given, other columns are not read, ties of the sample's order do not change
    the scores, an empty table gives an empty result; without any label all weights are 0.
    """
    model = learn(docs, labels, **options)
    parts, part = options.get("parts", 5), options.get("part", 0)
    return scored(docs, model).select(
        "doc_id", held_out("doc_id", parts, part).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"), "sentences",
    )
