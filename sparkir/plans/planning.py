"""Which kinds of retrieval a query calls for, decided from its wording with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.text import hyphen_tokens

MODES = ("lexical", "dense", "graph")

# The words that signal a kind of query.
QUESTION = ("what", "why", "how", "when", "where", "which", "who")
COMPARISON = ("compare", "comparison", "versus", "vs", "difference", "different", "similar", "similarity", "better", "contrast")
RELATIONSHIP = ("related", "relationship", "connected", "connection", "depends", "dependency", "dependencies", "linked", "links", "associated", "between", "upstream", "downstream")
EXPLANATORY = ("explain", "explanation", "describe", "description", "overview", "summarize", "summary", "reason", "reasons")
# Identifiers are vulnerability numbers, letters with a number behind . _ or -, and dates.
IDENTIFIER = r"(?i)\bCVE-\d{4}-\d{4,}\b|\b[A-Z]{2,}[._-]\d+[A-Z0-9._-]*\b|\b\d{4}[-/]\d{2}[-/]\d{2}\b"
# What each signal adds to (lexical, dense, graph).
SIGNALS = {
    "has_exact_phrase": (3, 0, 0),
    "has_identifier_signal": (4, 0, 0),
    "has_relationship_signal": (0, 0, 4),
    "has_comparison_signal": (0, 2, 2),
    "has_explanatory_signal": (0, 2, 0),
    "has_question_form": (0, 1, 0),
    "is_short": (1, 0, 0),
    "is_long": (0, 1, 0),
}


def _any_of(terms: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, words)))


def analyze(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) with normalized, terms, phrases, term_count and the six signals. Blank texts raise."""
    checks.none_left(queries.filter("text IS NULL OR trim(text) = ''"), "a query must have a text")
    q = queries.withColumn("normalized", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    q = q.withColumn("terms", hyphen_tokens("normalized"))
    quoted = F.transform(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.trim(p))
    q = q.withColumn("phrases", F.filter(quoted, lambda p: p != "")).withColumn("term_count", F.size("terms"))
    return q.withColumns({
        "has_exact_phrase": F.size("phrases") > 0,
        "has_question_form": F.contains("text", F.lit("?")) | _any_of(F.col("terms"), QUESTION),
        "has_comparison_signal": _any_of(F.col("terms"), COMPARISON),
        "has_relationship_signal": _any_of(F.col("terms"), RELATIONSHIP),
        "has_identifier_signal": F.col("text").rlike(IDENTIFIER),
        "has_explanatory_signal": _any_of(F.col("terms"), EXPLANATORY),
    })


def classify(analyzed: DataFrame) -> DataFrame:
    """analyzed with lexical_score, dense_score, graph_score, primary_mode and confidence.

    The single best score names the mode; a tie, or no signal at all, is hybrid. confidence is the best score's share of
    all, at most .5 on a tie, 0 without a signal.
    """
    flags = {"is_short": F.col("term_count") <= 2, "is_long": F.col("term_count") >= 6}
    def total(i: int) -> Column:
        parts = [F.when(flags.get(name, F.col(name) if name not in flags else None), float(points[i])).otherwise(0.0) for name, points in SIGNALS.items() if points[i]]
        return sum(parts[1:], parts[0])
    c = analyzed.withColumns({f"{mode}_score": total(i) for i, mode in enumerate(MODES)})
    best = F.greatest(*[F.col(f"{m}_score") for m in MODES])
    winners = sum(((F.col(f"{m}_score") == best).cast("int") for m in MODES[1:]), (F.col("lexical_score") == best).cast("int"))
    every = F.col("lexical_score") + F.col("dense_score") + F.col("graph_score")
    mode = F.when((best == 0) | (winners > 1), "hybrid")
    for m in MODES:
        mode = mode.when(F.col(f"{m}_score") == best, m)
    share = best / every
    confidence = F.when(best == 0, 0.0).when(winners > 1, F.least(share, F.lit(0.5))).otherwise(share)
    return c.withColumn("primary_mode", mode).withColumn("confidence", confidence)


def plan(queries: DataFrame, top_k: int = 10, candidate_multiplier: int = 5, graph_hops: int = 2) -> DataFrame:
    """One row per query: analysis, classification, enabled_modes, candidate_k, final_k, max_graph_hops.

    Every mode with a score of 1 or more is enabled, all three if none is; an explanatory query that would be dense alone
    is lexical as well.
    """
    checks.whole("top_k", top_k)
    checks.whole("candidate_multiplier", candidate_multiplier)
    checks.whole("graph_hops", graph_hops, 0)
    c = classify(analyze(queries))
    on = F.array_compact(F.array(*[F.when(F.col(f"{m}_score") >= 1, F.lit(m)) for m in MODES]))
    alone = (F.size(on) == 1) & F.array_contains(on, "dense") & F.col("has_explanatory_signal")
    modes = F.when(F.size(on) == 0, F.array(*map(F.lit, MODES))).when(alone, F.array(F.lit("lexical"), F.lit("dense"))).otherwise(on)
    c = c.withColumn("enabled_modes", modes)
    return c.withColumns({
        "candidate_k": F.lit(max(top_k, top_k * candidate_multiplier)),
        "final_k": F.lit(top_k),
        "max_graph_hops": F.when(F.array_contains("enabled_modes", "graph"), graph_hops).otherwise(0),
    })
