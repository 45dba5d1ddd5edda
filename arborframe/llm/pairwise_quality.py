"""Quality scores from preference pairs: a Bradley-Terry model on shape features of the text.

The chance that document a is preferred to b is the logistic function of w . (x_a - x_b).  Pairs
are drawn between labelled good and bad documents; the threshold is a quantile of the scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.llm.labelled import held_out, sample

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_AT = np.frombuffer(MARKS, np.uint8)


def features(text: str | None) -> list[float]:
    """Shares of byte classes, and how much words, word triples and lines repeat."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(len(raw), 1), max(len(words), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
    classes = [
        *seen[_MARK_AT] / n, seen[48:58].sum() / n, seen[65:91].sum() / letters,
        seen[128:].sum() / n, seen[10] / n, seen[32] / n, seen[:32].sum() / n,
    ]
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:])))
    top = counts.most_common(1)[0][1] if counts else 0
    ends = sum(w[-1:] in b".!?" for w in words)
    repeats = [
        len(counts) / m, top / m, 1 - triples / max(len(words) - 2, 1) if triples else 0.0,
        1 - len(set(lines)) / max(len(lines), 1), ends / m,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / m,
        sum(w[-1] < 48 for w in words) / m, max(map(len, words), default=0) / 100,
    ]
    shares = np.log1p(1000 * np.clip(np.array(classes + repeats, dtype=np.float64), 0, 10))
    sizes = [np.log1p(len(words)), n / m if n < 20 * m else 20.0, np.log1p(len(words) / max(len(lines), 1))]
    return [*shares.tolist(), *map(float, sizes)]


N_FEATURES = len(features(""))


@dataclass(frozen=True)
class Model:
    """Weights over standardised features, and the score that parts good from bad."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x, dtype=np.float64) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; one half is the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = 60_000, ridge: float = 1.0, steps: int = 30) -> Model:
    """Logistic loss on feature differences of drawn pairs, by Newton steps.

    The threshold is the quantile of the training scores whose level is the share of bad rows.
    With one class only, every score is one half.
    """
    width = x.shape[1] if len(x) else N_FEATURES
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    draw = np.random.default_rng(7)
    first = np.concatenate([good, draw.choice(good, pairs)])
    second = np.concatenate([draw.choice(bad, len(good)), draw.choice(bad, pairs)])
    d = z[first] - z[second]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is the other way
        slope = ridge * w - d.T @ p
        curve = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(z @ w)
    at = len(bad)  # as many training scores lie below the threshold as there are bad rows
    return Model(mean, scale, w, float((scores[at - 1] + scores[min(at, len(scores) - 1)]) / 2))


def learn(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = 20_000,
    parts: int = 3, part: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fit on at most ``most`` labelled documents, which are all that reach the driver."""
    chosen = F.broadcast(sample(labels, label, most, parts=parts, part=part))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        chosen, "doc_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            x = [features(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    made = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(
        run, "doc_id long, y int, x array<double>"
    )
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), N_FEATURES)
    return fit(x, np.array([r["y"] for r in got], dtype=np.int64))


def scored(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
    into: str = "quality_score",
) -> DataFrame:
    """All rows and columns of ``docs`` with a score; NULL counts as an empty text.

    A column named ``into`` is replaced.  Repeated rows get equal scores.
    """

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(model.score(x), dtype="float64")

    return docs.withColumn(into, score(F.col(f"`{text_col}`")))


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every document.

    NULL texts count as empty ones, which have a score as well; a NULL id counts as an empty one in
    ``held_out``.  Repeated rows come back as often as they were given, other columns are not read,
    an empty table gives an empty result; without any label every score is 0.5.
    """
    model = learn(docs, labels, **options)
    parts, part = options.get("parts", 3), options.get("part", 1)
    own = docs.select(F.col("doc_id"), F.col("text"))
    return scored(own, model, into="score").select(
        "doc_id", held_out("doc_id", parts, part).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
