"""Retrieval quality: precision, recall, reciprocal rank, average precision and NDCG of ranked runs against judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions import checks

METRICS = ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg", "precision_at_k", "recall_at_k", "ndcg_at_k")


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10, graded: bool = True) -> DataFrame:
    """One row per query of either table with the eight METRICS.

    run is (query_id, document_id, rank), ranks from 1 without gaps; qrels (query_id, document_id, relevance), of which
    rows above 0 are relevant. precision is hits by retrieved rows, repeats included, at k by min(k, rows); recall is hits
    by relevant documents, so repeats can lift it over 1; reciprocal_rank is that of the first hit; average_precision
    ignores repeats as hits, which still take up ranks; ndcg has gains 2 ** relevance - 1 (graded) or 1, discounts
    log2(rank + 1), and as ideal the retrieved list in its best order. What has nothing to divide by is 0.

    Run and judgements meet in one join; a query's list is at most as long as its top_k.
    """
    checks.whole("k", k)
    judged = qrels.filter("query_id IS NOT NULL AND document_id IS NOT NULL").groupBy("query_id", "document_id").agg(F.max("relevance").alias("relevance"))
    relevant = judged.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("long")).alias("n_relevant"))
    r = run.select("query_id", F.col("document_id").cast("string").alias("document_id"), "rank")
    j = r.join(judged, ["query_id", "document_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    j = j.withColumn("hit", (F.col("relevance") > 0).cast("long"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1 if graded else F.col("hit").cast("double")
    seen = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))
    j = j.withColumn("gain", gain).withColumn("first", (seen == 1).cast("long"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    j = j.withColumn("new", F.col("hit") * F.col("first")).withColumn("so_far", F.sum("new").over(by_rank))
    j = j.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank")))
    in_k = F.col("rank") <= k
    discount = lambda c: F.log2(F.col(c) + F.lit(1.0))
    # the ideal at k is the best k gains of the first k rows, so it is ranked among those
    j = j.withColumn("ideal_k", F.when(in_k, F.row_number().over(Window.partitionBy("query_id", in_k).orderBy(F.desc("gain"), "rank"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    a = j.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        total(F.when(F.col("new") == 1, F.col("so_far") / F.col("rank"))).alias("ap"),
        total(F.col("gain") / discount("rank")).alias("dcg"), total(F.col("gain") / discount("ideal")).alias("idcg"),
        F.sum(F.when(in_k, 1).otherwise(0)).alias("rows_k"), F.sum(F.when(in_k, F.col("hit")).otherwise(0)).alias("hits_k"),
        total(F.when(in_k, F.col("gain") / discount("rank"))).alias("dcg_k"), total(F.when(in_k, F.col("gain") / discount("ideal_k"))).alias("idcg_k"),
    )
    a = a.join(relevant, "query_id", "full")
    ratio = lambda x, y: F.coalesce(F.when(F.col(y) > 0, F.col(x) / F.col(y)), F.lit(0.0))
    found = F.coalesce(F.when(F.col("n_relevant") > 0, F.lit(1.0) / F.col("first_hit")), F.lit(0.0))
    columns = [ratio("hits", "rows"), ratio("hits", "n_relevant"), found, ratio("ap", "n_relevant"), ratio("dcg", "idcg"), ratio("hits_k", "rows_k"), ratio("hits_k", "n_relevant"), ratio("dcg_k", "idcg_k")]
    return a.select("query_id", *[F.round(c, 9).alias(n) for c, n in zip(columns, METRICS)])


def means(evaluated: DataFrame) -> DataFrame:
    """One row: the mean of every metric over all queries; mean reciprocal rank and mean average precision among them."""
    return evaluated.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count("*").alias("queries"))
