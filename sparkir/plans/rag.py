"""Evidence, context and answers from ranked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.operators.ranking import first_of_each
from sparkir.sources.corpus import attach_text

SEPARATOR = "\n\n"


def evidence(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id, text, score, rank): each document once, at its best rank. A missing or blank text fails the
    query."""
    once = attach_text(first_of_each(results).withColumn("document_id", F.col("document_id").cast("string")), documents)
    blank = F.when(F.col("text").isNull() | (F.trim("text") == ""), F.raise_error(F.lit("a result has no text")).cast("string"))
    return once.select("query_id", "document_id", F.coalesce(blank, F.col("text")).alias("text"), "score", "rank")


def plain_score(c: Column) -> Column:
    """A double as text, with six decimals, alike on every engine."""
    return F.format_string("%.6f", c)


def context(found: DataFrame, max_characters: int | None = None) -> DataFrame:
    """(query_id, context, sources, document_ids): numbered sections of evidence, joined by a blank line.

    With max_characters, sections are taken by rank up to the first that does not fit, separators included; later ones
    are not tried. A query whose first section does not fit has no row. The sections of a query are bounded by its
    top_k.
    """
    if max_characters is not None:
        checks.whole("max_characters", max_characters)
    w = Window.partitionBy("query_id").orderBy("rank")
    s = found.withColumn("i", F.row_number().over(w))
    section = F.concat(F.lit("[SOURCE "), F.col("i").cast("string"), F.lit("]\ndocument_id: "), "document_id", F.lit("\nretrieval_score: "), plain_score(F.col("score")), F.lit("\ntext:\n"), "text")
    s = s.withColumn("section", section)
    if max_characters is not None:
        length = F.length("section") + F.when(F.col("i") > 1, len(SEPARATOR)).otherwise(0)
        s = s.withColumn("held", F.sum(length).over(w)).filter(F.col("held") <= max_characters)
    parts = F.array_sort(F.collect_list(F.struct("i", "section", "document_id")))
    out = s.groupBy("query_id").agg(parts.alias("p"))
    return out.select("query_id", F.array_join(F.transform("p", lambda x: x["section"]), SEPARATOR).alias("context"), F.size("p").alias("sources"), F.transform("p", lambda x: x["document_id"]).alias("document_ids"))


def answers(queries: DataFrame, contexts: DataFrame, generate) -> DataFrame:
    """(query_id, answer, document_ids) of every query; null and an empty array where there is no context."""
    both = queries.select("query_id", "text").join(contexts, "query_id", "left")
    return both.select("query_id", generate(F.col("text"), F.col("context")).alias("answer"), F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"))
