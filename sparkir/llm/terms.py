"""Frequency of every distinct term (problem 4), and the rows of a posting table that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a maximal run of Unicode letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """The lower-cased terms of a text in order; an empty array for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def normal_term(term: Column | str) -> Column:
    return F.lower(F.trim(F.col(term) if isinstance(term, str) else term))


def counted_postings(postings: DataFrame, term: str = "term", doc: str = "doc_id", tf: str = "tf", at: str = "indexed_at", together: bool = False, most: int = 1_000_000) -> DataFrame:
    """(term, doc_id, tf): of each trimmed, lower-cased term and document the latest row.

    Null or blank terms and null documents are dropped, repeated rows count once, a null time is the earliest, a null tf
    is 0, and of rows of one time the greatest tf counts. The key is fine-grained, so the one shuffle is even.

    together: the result is partitioned by document, for operators that need documents whole, in the same one shuffle. Where
    a document has more than ``most`` rows to be combined, they are combined by term and document first.
    """
    when = F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    rows = postings.select(normal_term(term).alias("term"), F.col(doc).alias("doc_id"), when.alias("at"), F.coalesce(F.col(tf), F.lit(0)).cast("long").alias("tf"))
    rows = rows.filter("term IS NOT NULL AND term <> '' AND doc_id IS NOT NULL")
    if together:
        hot = not postings.groupBy(F.col(doc)).agg(F.count("*").alias("n")).filter(F.col("n") > most).isEmpty()
        if hot:
            rows = rows.groupBy("term", "doc_id", "at").agg(F.max("tf").alias("tf"))
        rows = rows.repartition("doc_id")
    else:
        rows = rows.repartition("term", "doc_id")
    # aggregations of numbers hash, those of structs would sort
    return rows.groupBy("term", "doc_id", "at").agg(F.max("tf").alias("tf")).groupBy("term", "doc_id").agg(F.max_by("tf", "at").alias("tf"))


def vocabulary_size(postings: DataFrame, term: str = "term") -> int:
    """About how many different terms there are, from one look at the rows."""
    return postings.select(F.approx_count_distinct(normal_term(term), 0.02)).first()[0]


def text_postings(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf) counted from whole texts; null and blank texts give no row."""
    return documents.select(F.col(doc).alias("doc_id"), F.explode(words(text)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def term_frequency(postings: DataFrame, records: int, rare_below: int = 2, common_share: float = 0.3) -> DataFrame:
    """(term, occurrences, documents, mark) for every term of per-record counts (term, doc_id, tf).

    mark is ``rare`` for terms of fewer than ``rare_below`` records, ``common`` for those of at least ``common_share`` of
    ``records`` records, else null; a term that is both counts as rare. Counts are combined by term inside each task
    before the shuffle, so a term of a third of all rows costs the same as any other. An empty table gives no rows.
    """
    counted = postings.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))
    mark = F.when(F.col("documents") < rare_below, F.lit("rare")).when(F.col("documents") >= common_share * records - 1e-6, F.lit("common"))
    return counted.withColumn("mark", mark)
