"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.llm.truncation import normal_source
from sparkir.operators.skew import salted_join, spread_rank

MOST_TARGETS = 100_000


def largest_total(shares: list[float], limits: list[float], tolerance: float) -> float:
    """The largest total at which sources that cannot give their share miss at most ``tolerance`` of it together."""
    lo, hi = 0.0, sum(limits) / max(1e-12, 1 - min(tolerance, 0.999999))
    for _ in range(200):
        mid = (lo + hi) / 2
        missed = sum(max(0.0, s - m / mid) for s, m in zip(shares, limits)) if mid else 0.0
        lo, hi = (mid, hi) if missed <= tolerance else (lo, mid)
    return lo


def repetition_rates(sized: DataFrame, targets: DataFrame, total: float | None = None, tolerance: float = 0.05) -> list[tuple]:
    """(source, target_share, max_repeats, documents, tokens, rate) per target source, by trimmed lower-cased name.

    rate is how often the source's documents are used on average: share x total / tokens, at most max_repeats. Shares of
    sources without tokens, which nothing can give, are divided among the others in proportion. Without ``total`` the
    mixture is as large as it can be with no more than ``tolerance`` of the shares out of reach.
    Negative or null shares count as 0, null or negative max_repeats as 0; of targets that name one source twice the
    shares add up and the greater max_repeats counts; null names are dropped.
    """
    t = targets.select(normal_source("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("m"))
    t = t.filter("source IS NOT NULL").groupBy("source").agg(F.sum("s").alias("target_share"), F.max("m").alias("max_repeats"))
    sizes = sized.filter("tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = t.join(sizes, "source", "left").na.fill(0, ["documents", "tokens"]).orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    whole = sum(r.target_share for r in rows if r.tokens and r.max_repeats)
    share = {r.source: r.target_share / whole if whole and r.tokens and r.max_repeats else 0.0 for r in rows}
    limits = [float(r.max_repeats * r.tokens) for r in rows]
    if total is None:
        total = largest_total([share[r.source] for r in rows], limits, tolerance)
    return [(r.source, r.target_share, r.max_repeats, r.documents, r.tokens, min(float(r.max_repeats), share[r.source] * total / r.tokens) if r.tokens else 0.0) for r in rows]


def mixture(sized: DataFrame, rates: list[tuple], seed: int = 17, least: int = 1_000_000) -> DataFrame:
    """(doc_id, source, tokens, copy): each document floor(rate) times, and once more with the chance of the fraction.

    sized is (doc_id, source, tokens), source trimmed and lower-cased. Documents without tokens and those of other sources
    are not used. The rates are one row per target, of which there is a checked number, and go to every task.

    The chance is drawn by hash of seed, id and tokens, so it does not depend on partitions or attempts. Documents of a source
    are drawn among those of like size, by factors of two: of n in such a stratum the floor(fraction x n) of least hash get
    their copy, and the next one with the chance of what is left, drawn by the stratum's hash. Every document has the chance
    of the fraction, as if drawn alone, but long and short texts are drawn in their proportion, and a source is off its
    share by about one text per stratum, however many it has. Strata of more than ``least`` texts are ranked in ranges.
    """
    table = sized.sparkSession.createDataFrame([(r[0], float(r[5])) for r in rates], "source string, rate double")
    used = sized.filter("tokens > 0").select("doc_id", "source", "tokens").join(F.broadcast(table), "source").filter("rate > 0")
    uniform = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)) / float(1 << 52)).cast("double")
    used = used.withColumn("stratum", F.floor(F.log2("tokens"))).withColumn("chosen", -uniform("doc_id", "tokens"))
    key = ["source", "stratum"]
    ranked = spread_rank(used, key, "chosen", "place", least=least)
    counts = used.groupBy(*key).agg(F.count("*").alias("n"))
    ranked = salted_join(ranked, counts, key, F.col("doc_id"), "inner", least=least)
    quota = (F.col("rate") - F.floor("rate")) * F.col("n")
    extra = (F.col("place") <= F.floor(quota)) | ((F.col("place") == F.floor(quota) + 1) & (uniform("source", "stratum") < quota - F.floor(quota)))
    ranked = ranked.withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int")).filter("copies > 0")
    return ranked.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def share_report(mixed: DataFrame, rates: list[tuple]) -> DataFrame:
    """(source, target_share, expected_share, reached_share, max_repeats, rate, documents, tokens, mixed_tokens) per target
    source. expected_share is the mean over all seeds: below the target where max_repeats holds the source back."""
    table = mixed.sparkSession.createDataFrame([(a, float(b), int(c), int(d), int(e), float(f)) for a, b, c, d, e, f in rates], "source string, target_share double, max_repeats int, documents long, tokens long, rate double")
    mean = sum(e * f for *_, e, f in rates) or 1.0
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    every = got.agg(F.sum("mixed_tokens")).first()[0] or 1
    out = table.join(got, "source", "left").na.fill(0, ["mixed_tokens"])
    return out.select("source", "target_share", (F.col("tokens") * F.col("rate") / F.lit(float(mean))).alias("expected_share"), (F.col("mixed_tokens") / F.lit(float(every))).alias("reached_share"), "max_repeats", "rate", "documents", "tokens", "mixed_tokens")
