"""Eager checks of operator parameters: TypeError for a wrong type, ValueError for a value out of range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(name: str, value: object) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string")
    if not value.strip():
        raise ValueError(f"{name} must not be blank")
    return value


def whole(name: str, value: object, least: int = 1) -> int:
    if not isinstance(value, int) or isinstance(value, bool):
        raise TypeError(f"{name} must be an integer")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def real(name: str, value: object, least: float | None = None, most: float | None = None) -> float:
    if not isinstance(value, float):
        raise TypeError(f"{name} must be a float")
    if value != value or (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name} is out of range")
    return value


def one_of(name: str, value: object, allowed: tuple[str, ...]) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a string")
    v = value.strip().lower()
    if v not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return v


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """df, after checking that no key repeats; the least repeated one is named in the ValueError."""
    twice = df.groupBy(key).count().filter("count > 1").orderBy(key).limit(1).collect()
    if twice:
        raise ValueError(f"{what} {twice[0][0]!r} occurs {twice[0][1]} times")
    return df


def none_left(df: DataFrame, what: str, error: type[Exception] = ValueError) -> None:
    """Raises if df has a row; one of them is named."""
    bad = df.limit(1).collect()
    if bad:
        raise error(f"{what}: {bad[0].asDict(recursive=True)}")


def require(condition, message: str):
    """A boolean column that fails the query where the condition does not hold."""
    return F.assert_true(condition, message).isNull()
