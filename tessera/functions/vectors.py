"""Vector arithmetic on array columns; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean", "manhattan")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), term), F.lit(0.0), lambda s, x: s + x)


def checked(a: Column, b: Column, value: Column) -> Column:
    """value, null if a vector is missing, or an error if the vectors differ in length."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return checked(a, b, fold(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(fold(v, v, lambda x, y: x * y))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    # greatest and least skip nulls
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))) if clamp else value


def euclidean(a: Column, b: Column) -> Column:
    return checked(a, b, F.sqrt(fold(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return checked(a, b, fold(a, b, lambda x, y: F.abs(x - y)))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Smaller is nearer: 1 - cosine, -dot, L2, L1."""
    return {"cosine": lambda: 1 - cosine(a, b), "dot": lambda: -dot(a, b), "euclidean": lambda: euclidean(a, b), "manhattan": lambda: manhattan(a, b)}[metric]()


def score(a: Column, b: Column, metric: str, mode: str = "raw") -> Column:
    """Larger is nearer. mode unit maps to (0, 1]: (cosine + 1) / 2, the logistic of dot, 1 / (1 + distance); raw keeps cosine and dot as they are."""
    if metric == "cosine":
        return cosine(a, b) if mode == "raw" else (cosine(a, b) + 1) / 2
    if metric == "dot":
        return dot(a, b) if mode == "raw" else 1 / (1 + F.exp(-dot(a, b)))
    return 1 / (1 + distance(a, b, metric))
