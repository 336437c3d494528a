"""One ranking from several differently scaled scores (problem 3): robust rank aggregation.

Scores are replaced by places in their own list, so no scale matters. An item's normalised places, sorted, are compared
with those of random lists: the k-th smallest of n uniform places follows Beta(k, n - k + 1). The least of these
probabilities, times n, is the item's significance.
"""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.operators.skew import hot_keys, salted_join, split_hot, spread_rank
from sparkir.session import stage

SIGNALS = ("lexical", "dense", "graph")


def counting_results(results: DataFrame, by: tuple[str, ...] = ("query_id", "signal", "document_id")) -> DataFrame:
    """(query_id, signal, document_id, strength): of each key the latest row that has a score; strength grows with quality.

    Null and NaN scores, null keys and unknown signals are dropped; rows of one time: the best counts; a null time is the
    earliest. Distances (metadata names the metric euclidean) are negated. One shuffle by columns of the key, ``by``, serves
    both aggregations; the result is partitioned by them.
    """
    rows = results.filter("score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND document_id IS NOT NULL")
    rows = rows.filter(F.col("signal").isin(*SIGNALS))
    named = F.contains(F.lower("metadata"), F.lit("euclidean"))  # spares most rows the parser
    far = F.coalesce(named & (F.lower(F.get_json_object("metadata", "$.metric")) == "euclidean"), F.lit(False))
    strength = F.when(far, -F.col("score")).otherwise(F.col("score")) + F.lit(0.0)
    at = F.coalesce(F.col("retrieved_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    key = ["query_id", "signal", "document_id"]
    rows = rows.select(*key, strength.alias("strength"), at.alias("at")).repartition(*by)
    return rows.groupBy(*key, "at").agg(F.max("strength").alias("strength")).groupBy(*key).agg(F.max_by("strength", "at").alias("strength"))


def counting_signals(queries: DataFrame) -> DataFrame:
    """(query_id, c_lexical, c_dense, c_graph): whether a signal counts, as its score is above 0, or as none is; a repeated
    query_id: above 0 in any of its rows."""
    own = [F.max(F.coalesce(F.nanvl(F.col(f"{s}_score"), F.lit(0.0)), F.lit(0.0)) > 0).alias(f"own_{s}") for s in SIGNALS]
    q = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(*own)
    none = ~(F.col("own_lexical") | F.col("own_dense") | F.col("own_graph"))
    return q.select("query_id", *[(F.col(f"own_{s}") | none).alias(f"c_{s}") for s in SIGNALS])


def significance(places: list[Column]) -> Column:
    """The corrected least beta probability of the normalised places, of which those of lists that do not count are null."""
    lists = sum((p.isNotNull().cast("int") for p in places[1:]), places[0].isNotNull().cast("int"))
    r = F.array_sort(F.array_compact(F.array(*places))) if len(places) > 3 else None

    def smallest(k: int, n: int) -> Column:
        if r is not None:
            return F.get(r, F.lit(k - 1))
        if n == 1:
            return F.coalesce(*places)
        low, high = F.least(*places), F.greatest(*places)  # both skip nulls
        if k in (1, n):
            return low if k == 1 else high
        return sum(places[1:], places[0]) - low - high

    def corrected(n: int) -> Column:
        def beyond(k: int) -> Column:  # P(at least k of n uniform places are <= the k-th)
            x = smallest(k, n)
            factors = ([F.lit(float(comb(n, j)))] * (comb(n, j) > 1) + [x] * j + [F.lit(1.0) - x] * (n - j) for j in range(k, n + 1))
            return reduce(add, (reduce(mul, f) for f in factors))  # products are far cheaper than powers

        every = [beyond(k) for k in range(1, n + 1)]
        return F.least(F.lit(1.0), (F.least(*every) if n > 1 else every[0]) * F.lit(float(n)))

    return F.coalesce(*[F.when(lists == n, corrected(n)) for n in range(1, len(places) + 1)])


OUT = ["query_id", "document_id", "lists", *[f"place_{s}" for s in SIGNALS], "shortest", "significance"]


def _scored(items: DataFrame) -> DataFrame:
    """OUT and __s, by which ranks are ordered, of items with p_ (places), n_ (lengths) and c_ (whether it counts) per signal."""
    place = {s: F.when(F.col(f"c_{s}"), F.col(f"p_{s}")) for s in SIGNALS}
    normal = [F.when(F.col(f"c_{s}"), F.coalesce(F.col(f"p_{s}").cast("double") / F.col(f"n_{s}"), F.lit(1.0))) for s in SIGNALS]
    count = sum((F.col(f"c_{s}").cast("int") for s in SIGNALS[1:]), F.col(f"c_{SIGNALS[0]}").cast("int"))
    shortest = F.least(*[F.when(F.col(f"c_{s}"), F.coalesce(F.col(f"n_{s}"), F.lit(0).cast("long"))) for s in SIGNALS])
    scored = items.filter(F.coalesce(*place.values()).isNotNull()).withColumns({f"r_{s}": c for s, c in zip(SIGNALS, normal)})
    scored = scored.select("query_id", "document_id", count.alias("lists"), *[place[s].alias(f"place_{s}") for s in SIGNALS], shortest.alias("shortest"), significance([F.col(f"r_{s}") for s in SIGNALS]).alias("significance"))
    # ranked by rounded logarithms: they tell apart the tiny probabilities of long lists, and not the noise of floats
    return scored.withColumn("__s", F.round(-F.log("significance"), 9))


def _one(s: str, c: str) -> Column:
    return F.max(F.when(F.col("signal") == s, F.col(c)))


def _fuse_together(results: DataFrame, signals: DataFrame) -> DataFrame:
    """`fuse` where all rows of a query fit in a task: one shuffle by query serves every step."""
    counted = counting_results(results, ("query_id",))
    own = Window.partitionBy("query_id", "signal")
    ranked = counted.withColumn("place", F.rank().over(own.orderBy(F.desc("strength"))).cast("long")).withColumn("n", F.count("*").over(own))
    items = ranked.groupBy("query_id", "document_id").agg(*[_one(s, "place").alias(f"p_{s}") for s in SIGNALS], *[_one(s, "n").alias(f"m_{s}") for s in SIGNALS])
    of = Window.partitionBy("query_id")
    items = items.withColumns({f"n_{s}": F.max(f"m_{s}").over(of) for s in SIGNALS}).drop(*[f"m_{s}" for s in SIGNALS])
    items = items.join(signals.hint("merge"), "query_id", "left").na.fill(True, [f"c_{s}" for s in SIGNALS])
    return _scored(items).withColumn("rank", F.rank().over(of.orderBy(F.desc("__s"))).cast("long")).select(*OUT, "rank")


def _fuse_spread(results: DataFrame, signals: DataFrame, hot: list[tuple], least: int) -> DataFrame:
    """`fuse` of hot queries: places and ranks are computed in ranges of the score, joins on query_id are salted."""
    counted = stage(counting_results(results), "counted")
    ranked = spread_rank(counted, ["query_id", "signal"], "strength", "place", least=least)
    lengths = counted.groupBy("query_id", "signal").agg(F.count("*").alias("n")).groupBy("query_id").agg(*[_one(s, "n").alias(f"n_{s}") for s in SIGNALS])
    wanted = lengths.join(signals.hint("merge"), "query_id", "left").na.fill(True, [f"c_{s}" for s in SIGNALS])
    items = ranked.groupBy("query_id", "document_id").agg(*[_one(s, "place").alias(f"p_{s}") for s in SIGNALS])
    items = salted_join(items, wanted, ["query_id"], F.col("document_id"), "inner", least=least, hot=hot)
    return spread_rank(stage(_scored(items), "significance"), ["query_id"], "__s", "rank", least=least, hot=hot).select(*OUT, "rank")


def fuse(results: DataFrame, queries: DataFrame, least: int = 1_000_000) -> DataFrame:
    """(query_id, document_id, lists, place_lexical, place_dense, place_graph, shortest, significance, rank): one list per
    query.

    lists is the number of counting signals, shortest the length of the shortest of their lists; a place is 1 + the number
    of strictly better documents of that signal, null if it does not count or lacks the document. Documents that no counting
    signal has are left out. A place is normalised by the length of its list; a counting list without the document, or an
    empty one, gives 1. rank orders by significance (equal ones share a rank). Queries without a row in ``queries`` use all
    signals; those without results give no rows.

    The results of a query meet in one task, in a single shuffle, unless it has more than ``least`` rows: such hot queries
    are ranked in ranges of their scores.
    """
    signals = counting_signals(queries)
    hot = hot_keys(results.select("query_id"), ["query_id"], least=least)
    if not hot:
        return _fuse_together(results, signals)
    cold, warm = split_hot(results, ["query_id"], hot)
    return _fuse_together(cold, signals).unionByName(_fuse_spread(warm, signals, hot, least))


def agreed(fused: DataFrame, within: int = 5) -> DataFrame:
    """(query_id, document_id) at place ``within`` or better in every one of at least two counting signals.

    The normalised places of such a document are at most x = within / shortest, and the chance that all of n random places
    are is x ** n, so its significance is at most n x ** n: the aggregation gives the candidates, the places decide."""
    x = F.lit(float(within)) / F.col("shortest")
    bound = reduce(lambda c, n: F.when(F.col("lists") == n, reduce(mul, [x] * n) * n).otherwise(c), range(2, len(SIGNALS) + 1), F.lit(0.0))
    significant = F.col("significance") <= F.least(F.lit(1.0), bound) * (1 + 1e-9)
    near = sum((F.coalesce((F.col(f"place_{s}") <= within).cast("int"), F.lit(0)) for s in SIGNALS), F.lit(0))
    return fused.filter((F.col("lists") >= 2) & (F.col("shortest") > 0) & significant & (near == F.col("lists"))).select("query_id", "document_id").distinct()
