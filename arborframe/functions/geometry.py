"""3-D geometry as column expressions, plus names of coordinate column triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def triple(prefix: str = "", suffix: str = "") -> list[str]:
    """Column names of a coordinate triple, e.g. ``triple('target_')``."""
    return [f"{prefix}{a}{suffix}" for a in AXES]


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def vector(start: Sequence[str | Column], end: Sequence[str | Column]) -> list[Column]:
    """Components of ``end - start``."""
    return [e - s for s, e in zip(cols(start), cols(end))]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Sequence[str | Column], b: Sequence[str | Column]) -> Column:
    return norm(vector(a, b))


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle in radians; exactly 0 for identical vectors, NULL if one has no length."""
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])
    size = norm(a) * norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))
    return F.when(same, F.lit(0.0)).when(size > 0, F.acos(cosine))


def unit(v: Sequence[Column]) -> list[Column]:
    size = norm(v)
    return [F.when(size > 0, c / size) for c in v]


def rotate(matrix: Column, v: Sequence[Column]) -> list[Column]:
    """``matrix . v`` for a 3x3 ``array<array<double>>`` column."""
    return [dot([matrix[r][c] for c in range(3)], v) for r in range(3)]


def identity_matrix() -> Column:
    return F.array(
        *[F.array(*[F.lit(1.0 if r == c else 0.0) for c in range(3)]) for r in range(3)]
    )
