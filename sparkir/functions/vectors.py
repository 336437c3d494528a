"""Similarity of array columns, evaluated as doubles in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def valid_vector(c: Column | str, dimension: int | None = None) -> Column:
    """Whether an array is non-empty, of this dimension, and of finite numbers; false for null."""
    v = _col(c)
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = ok & (F.size(v) == dimension) if dimension is not None else ok
    return F.coalesce(ok, F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; an error where lengths differ, null where either is null."""
    x, y = _col(a), _col(b)
    same = F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors must have the same dimension")).cast("double"))
    return F.coalesce(same, _sum(F.zip_with(x, y, lambda p, q: p * q)))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str, on_zero: str = "error") -> Column:
    """Cosine similarity. on_zero: what a zero vector gives, ``error`` or ``zero`` (0.0)."""
    if on_zero not in ("error", "zero"):
        raise ValueError("on_zero must be error or zero")
    d = norm(a) * norm(b)
    zero = F.raise_error(F.lit("a zero vector has no direction")).cast("double") if on_zero == "error" else F.lit(0.0)
    return F.when(d == 0, zero).otherwise(dot(a, b) / d)


def euclidean(a: Column | str, b: Column | str) -> Column:
    x, y = _col(a), _col(b)
    same = F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors must have the same dimension")).cast("double"))
    return F.coalesce(same, F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))))


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean}[metric](a, b)
