"""Keeping postings up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.functions.text import Analyzer
from sparkir.operators.index import postings, tokens


def index_stream(documents: DataFrame, path: str, checkpoint: str, analyzer: Analyzer | None = None, at: str | None = None, **trigger):
    """Starts a query that appends the postings of streamed documents (doc_id, text) to ``path``/postings, by batch.

    Each micro-batch overwrites only its own partition, so a batch that is run again after a failure is not counted
    twice. A document that arrives again has postings in several batches; `latest_postings` keeps the last. Of its versions in
    one batch the one of greatest ``at`` (a column; ties and without it: the greatest text) counts.
    """
    a = analyzer or Analyzer()

    def write(batch: DataFrame, batch_id: int) -> None:
        version = F.struct(*([F.col(at).alias("at")] if at else []), "text")
        once = batch.groupBy("doc_id").agg(F.max(version).alias("v")).select("doc_id", "v.text")
        out = postings(tokens(once, a)).withColumn("batch_id", F.lit(batch_id))
        out.drop("batch_id").write.mode("overwrite").parquet(f"{path}/postings/batch_id={batch_id}")
        once.select("doc_id").write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_postings(spark, path: str) -> DataFrame:
    """(term, doc_id, tf) of the last batch that held each document."""
    p = spark.read.parquet(f"{path}/postings")
    last = spark.read.parquet(f"{path}/seen").groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return p.join(last, ["doc_id", "batch_id"], "left_semi").select("term", "doc_id", "tf")


def windowed_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window start, keys, events): counts per tumbling window with a watermark; works on streams and on tables."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), *keys, "events")
