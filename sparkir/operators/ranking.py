"""Scores and rankings: BM25, TF-IDF, min-max score fusion, sorting, reciprocal rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.operators import blocks
from sparkir.operators.skew import salted_join

#: Scores are rounded before they are ranked, so that the order of float sums cannot flip ties.
DIGITS = 9


def ranked(scores: DataFrame, top_k: int | None, tie: str, by: tuple[str, ...] = ("query_id",), score: str = "score", ascending: bool = False) -> DataFrame:
    """scores with rank from 1 per query, best first, ties by ``tie``; at most top_k rows per query.

    The limit is a row_number filter, which Spark also applies inside each task before the shuffle.
    """
    order = F.asc(score) if ascending else F.desc(score)
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))
    return out if top_k is None else out.filter(F.col("rank") <= checks.whole("top_k", top_k, 0))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """The saturated, length-normalised term frequency; 0 without occurrences or in an empty corpus."""
    checks.real("k1", k1, 0.0)
    checks.real("b", b, 0.0, 1.0)
    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return F.when((avgdl <= 0) | (tf <= 0), 0.0).otherwise(value)


def bm25_scores(terms: DataFrame, index, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, hits) of every document with any of a query's terms; repeated terms count repeatedly.

    hits is the number of different terms of the query that the document has. Query terms meet the postings in one
    equi-join, whose skewed terms adaptive execution splits, and scores are summed inside each task before they move. Postings
    that carry the length of their document (dl) are not joined with the lengths.
    """
    wanted = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = wanted.join(index.frequencies, "term")
    hit = index.postings.join(asked, "term")
    hit = (hit if "dl" in index.postings.columns else hit.join(index.lengths, "doc_id")).join(F.broadcast(index.stats))
    part = F.col("times") * bm25_idf(F.col("df"), F.col("n")) * bm25_tf(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.count("*").alias("hits"))


def tfidf_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def tfidf_scores(terms: DataFrame, index) -> DataFrame:
    """(query_id, doc_id, term, tf, idf, tfidf) of each term of a query in each document that has it; postings that are kept
    packed meet the queries where they are."""
    if blocks.can_pack(index.packed):
        wanted = terms.select("query_id", "term").distinct().join(index.frequencies, "term").join(F.broadcast(index.stats.select("n")))
        found = blocks.every_hit(wanted, index.packed, lambda df, n: np.log((n + 1.0) / (df + 1.0)) + 1.0)
        return found.withColumn("tfidf", F.col("tf") * F.col("idf"))
    hit = terms.select("query_id", "term").distinct().join(index.frequencies, "term").join(index.postings, "term").join(F.broadcast(index.stats.select("n")))
    idf = tfidf_idf(F.col("df"), F.col("n"))
    return hit.select("query_id", "doc_id", "term", "tf", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf"))


def minmax(signals: DataFrame) -> DataFrame:
    """signals (query_id, signal, doc_id, score) with norm: scores scaled to [0, 1] per query and signal, 0.0 if all are
    equal. Extremes are aggregated and joined back, so no task holds a whole list."""
    ends = signals.groupBy("query_id", "signal").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    out = salted_join(signals, ends, ["query_id", "signal"], F.col("doc_id"), "inner")
    return out.withColumn("norm", F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def score_fusion(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): weighted sums of normalised scores. Signals without a weight, or of weight 0, are left
    out, with the documents that only they have; a signal without a document adds nothing to it."""
    checks.none_left(weights.filter("weight IS NULL OR isnan(weight) OR weight < 0"), "invalid weight")
    # a weight per name of a signal, so few rows; Spark decides by their size whether to broadcast them
    used = minmax(signals).join(weights.filter("weight <> 0"), "signal")
    return used.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("norm")), DIGITS).alias("score"))


def sort_rerank(scores: DataFrame, top_k: int | None = None) -> DataFrame:
    """Best score first, ties by the smaller (integer) doc_id; top_k may be 0 or None."""
    return ranked(scores, top_k, "doc_id")


def rrf(lists: DataFrame, top_k: int | None = 10, k: int = 60) -> DataFrame:
    """(query_id, document_id, score, rank): sum of 1 / (k + rank) over lists (query_id, list, document_id, rank).

    Of a document that a list repeats the best rank counts; the repeats still occupy theirs. Ties: the smaller id as a
    string. If the lists have a column metadata, the result has it too: that of the first list, by ``list_at`` where there is
    such a column, else by name, that found the document, even if it is null there.
    """
    checks.whole("k", k)
    carried = [F.min_by(F.struct("metadata"), F.col("rank")).alias("m")] if "metadata" in lists.columns else []
    at = F.min("list_at").alias("at") if "list_at" in lists.columns else F.first("list").alias("at")
    best = lists.groupBy("query_id", "list", F.col("document_id").cast("string").alias("document_id")).agg(F.min("rank").alias("rank"), at, *carried)
    kept = [F.min_by("m", F.struct("at", "list")).alias("m")] if carried else []
    fused = best.groupBy("query_id", "document_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("score"), *kept)
    if carried:
        fused = fused.select("query_id", "document_id", "score", F.col("m.metadata").alias("metadata"))
    return ranked(fused, None if top_k is None else checks.whole("top_k", top_k), "document_id")


def first_of_each(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, document_id, score, rank) without later repeats of a document in a list."""
    w = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return candidates.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")


def cross_rerank(candidates: DataFrame, queries: DataFrame, documents: DataFrame, score: Callable[[Column, Column], Column], top_k: int = 10) -> DataFrame:
    """(query_id, document_id, score, rank) by a cross-encoder column function of (query text, document text).

    Repeats go before anything is scored; a candidate without a text, or with a blank one, fails the query.
    """
    checks.whole("top_k", top_k)
    once = first_of_each(candidates).select("query_id", F.col("document_id").cast("string").alias("document_id"))
    q = queries.select("query_id", F.col("text").alias("__q"))
    d = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("__t"))
    both = once.join(q, "query_id").join(d, "document_id", "left")
    blank = F.when(F.col("__t").isNull() | (F.trim("__t") == ""), F.raise_error(F.lit("a candidate has no text")).cast("string"))
    both = both.withColumn("__t", F.coalesce(blank, F.col("__t")))
    scored = both.withColumn("score", score(F.col("__q"), F.col("__t"))).select("query_id", "document_id", "score")
    return ranked(scored, top_k, "document_id")


def occurrences(query: Column, text: Column) -> Column:
    """How often the lower-cased query occurs in the lower-cased text, as a double, without Python; 0.0 for an empty query."""
    q, t = F.lower(query), F.lower(text)
    return F.when(F.length(q) == 0, 0.0).otherwise(((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("double"))


def word_occurrences(query: Column, text: Column) -> Column:
    """How often the words of the lower-cased query occur in the lower-cased text, repeated words repeatedly, as a double."""
    t = F.lower(text)
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    times = F.transform(words, lambda w: ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("double"))
    return F.aggregate(times, F.lit(0.0), lambda a, b: a + b)
