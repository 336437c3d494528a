"""Joins and ranks over keys of which one may hold a third of all rows.

Hot keys are found exactly: a key is hot when its rows exceed what one task should hold (``least``), and ``total /
parts``, so there are fewer than ``parts`` hot keys, whatever the data, and a table of them is safe to broadcast. At the
default a key of a hundred thousandth of all rows is hot. Everything else goes the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.session import stage

#: At most so many hot keys: a broadcast of a few megabytes.
PARTS = 100_000
LEAST = 100_000


def hot_keys(df: DataFrame, keys: list[str], parts: int = PARTS, least: int = LEAST) -> list[tuple]:
    """``(key..., rows)`` of the keys with more than max(least, total / parts) rows; fewer than ``parts`` of them.

    Null keys are never hot. The counts are combined on the map side, so a hot key costs one row per task.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__rows"))
    most = counts.agg(F.sum("__rows").alias("total"), F.max("__rows").alias("most")).first()
    bound = max(least, (most.total or 0) / parts)
    if (most.most or 0) <= bound:
        return []
    return [tuple(r) for r in counts.filter(F.col("__rows") > bound).select(*keys, "__rows").collect()]


def _hot_frame(df: DataFrame, keys: list[str], hot: list[tuple], least: int) -> DataFrame:
    fields = [df.schema[k] for k in keys]
    ddl = ", ".join(f"`__k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", `__salts` int"
    rows = [(*r[:-1], int(r[-1] // least) + 1) for r in hot]
    return df.sparkSession.createDataFrame(rows, ddl)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left",
                where: Column | None = None, parts: int = PARTS, least: int = LEAST, hot: list[tuple] | None = None) -> DataFrame:
    """Equi-join of a long, skewed left side with a right side that has few rows per key.

    Rows of a hot key on the left are split over ``rows / least`` salts by ``spread`` (a column of ``left`` that differs
    within the key); the right rows of that key are repeated once per salt. how: inner, left, left_semi or left_anti.
    Null keys match nothing. Columns beside the keys must have different names on the two sides. where: a further
    condition on such columns. hot: the result of `hot_keys` of a table with at least as many rows per key, where that is
    cheaper to count than ``left``.
    """
    hot = hot_keys(left, keys, parts, least) if hot is None else hot

    def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        if where is None:
            return a.join(b, on, how)
        b = b.select(*[F.col(k).alias(f"__r_{k}") for k in on], *[c for c in b.columns if c not in on])
        both = where
        for k in on:
            both = both & (F.col(k) == F.col(f"__r_{k}"))
        return a.join(b, both, how).drop(*[f"__r_{k}" for k in on])

    if not hot:
        return join(left, right, keys)
    table = _hot_frame(left, keys, hot, least)

    def match(side: DataFrame) -> Column:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & (side[k] == table[f"__k{i}"])
        return on

    salts = F.coalesce(F.col("__salts"), F.lit(1))
    a = left.withColumn("__spread", F.xxhash64(spread))
    a = a.join(F.broadcast(table), match(a), "left").withColumn("__salt", F.pmod("__spread", salts).cast("int"))
    a = a.drop("__salts", "__spread", *[f"__k{i}" for i in range(len(keys))])
    b = right.join(F.broadcast(table), match(right), "left")
    b = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    b = b.drop("__salts", *[f"__k{i}" for i in range(len(keys))])
    return join(a, b, [*keys, "__salt"]).drop("__salt")


def split_hot(df: DataFrame, keys: list[str], hot: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(cold, hot) rows of df; null keys are cold."""
    table = _hot_frame(df, keys, hot, LEAST)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (df[k] == table[f"__k{i}"])
    return df.join(F.broadcast(table), on, "left_anti"), df.join(F.broadcast(table), on, "left_semi")


def spread_rank(df: DataFrame, keys: list[str], value: str, name: str = "place",
                parts: int = PARTS, least: int = LEAST, hot: list[tuple] | None = None) -> DataFrame:
    """1 + the number of rows of the same keys with a greater ``value`` (SQL RANK, descending), without one task per key.

    The rows of hot keys are partitioned by ranges of (keys, value), about ``least`` rows each: equal values share a
    range, the rank inside a range is a window over at most that range, and the rows of the ranges above are added.
    value must be a non-null number. A null key is a group of its own. hot: as for `salted_join`. With hot keys, df is
    read twice, and their rows are staged with the number of their range, which must not change between two readings.
    """
    hot = hot_keys(df, keys, parts, least) if hot is None else hot
    plain = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))).cast("long")
    if not hot:
        return df.withColumn(name, plain)
    cold, warm = split_hot(df, keys, hot)
    ranges = sum(int(r[-1] // least) + 1 for r in hot)
    ranged = stage(warm.repartitionByRange(ranges, *keys, F.desc(value)).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__rows"))  # at most one row per range and key
    above = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__above", F.coalesce(F.sum("__rows").over(above), F.lit(0))).drop("__rows")
    inner = Window.partitionBy(*keys, "__range").orderBy(F.desc(value))
    out = ranged.withColumn("__place", F.rank().over(inner)).join(sizes, [*keys, "__range"])
    out = out.withColumn(name, (F.col("__place") + F.col("__above")).cast("long")).select(*df.columns, name)
    return cold.withColumn(name, plain).select(*df.columns, name).unionByName(out)
