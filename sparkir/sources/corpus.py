"""Corpora: JSON and Parquet sources, validation, and set operations by document id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkir import schemas
from sparkir.functions import checks


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, metadata) of a JSON file that holds an array of objects, or of JSON lines.

    Raises ValueError naming the first bad record by its number from 1: broken JSON, no object, document_id or text missing or
    of a wrong type, a negative id; and for a repeated id. Unknown metadata fields are ignored; missing metadata is null. A file
    is read by one task, as an array cannot be split: large corpora are JSON lines for `load_lines`, or Parquet.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("array", F.ltrim("value").startswith("["))
    items = F.when(F.col("array"), F.from_json("value", "array<string>")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    none = F.array(F.lit(None).cast("string"))
    empty = F.regexp_like("value", F.lit(r"^\s*(\[\s*\])?\s*$"))
    rows = whole.filter(~empty).select(F.posexplode(F.coalesce(items, none)).alias("at", "json")).withColumn("record", F.col("at") + 1)
    return _documents(rows)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, metadata) of JSON lines, which are read in splits by many tasks; else as `load_corpus`, but a bad record is
    named by its beginning."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return _documents(lines.select(F.col("value").alias("json"), F.substring("value", 1, 80).alias("record")))


def _documents(rows: DataFrame) -> DataFrame:
    parsed = rows.withColumn("d", F.from_json("json", schemas.CORPUS_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("d._corrupt_record").isNull() & F.col("d.document_id").isNotNull() & F.col("d.text").isNotNull() & (F.col("d.document_id") >= 0)
    first = parsed.filter(~F.coalesce(good, F.lit(False))).agg(F.min("record")).first()[0]
    if first is not None:
        raise ValueError(f"invalid document record: {first}")
    docs = parsed.select(F.col("d.document_id").alias("doc_id"), F.col("d.text").alias("text"), F.col("d.metadata").alias("metadata"))
    return checks.unique(docs, "doc_id", "document id")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Any Parquet table with doc_id and text; other columns are carried along and pruned where unused."""
    df = spark.read.parquet(path)
    missing = {"doc_id", "text"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return df


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Rows that are no documents: null or negative id, or null text. An empty text is a document."""
    return documents.filter("doc_id IS NULL OR doc_id < 0 OR text IS NULL")


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    """Rows that are no chunks: null or negative id or position, or null text."""
    return chunks.filter("chunk_id IS NULL OR chunk_id < 0 OR text IS NULL OR position IS NULL OR position < 0")


def add_documents(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """The union; ValueError if an id is invalid or occurs twice."""
    checks.none_left(invalid_documents(new), "invalid document")
    return checks.unique(corpus.unionByName(new, allowMissingColumns=True), "doc_id", "document id")


def get_document(corpus: DataFrame, doc_id: int) -> DataFrame:
    """The row of one id; KeyError if there is none."""
    row = corpus.filter(F.col("doc_id") == checks.whole("doc_id", doc_id, 0))
    if row.isEmpty():
        raise KeyError(doc_id)
    return row


def remove_documents(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The corpus without the rows whose doc_id is in ids; rows of null id stay."""
    return corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def attach_text(results: DataFrame, documents: DataFrame, id_column: str = "document_id") -> DataFrame:
    """results with the text of their documents; ids compare as strings, unknown ones get null."""
    texts = documents.select(F.col("doc_id").cast("string").alias("__id"), F.col("text"))
    return results.join(texts, F.col(id_column).cast("string") == F.col("__id"), "left").drop("__id")
