"""References to records that do not exist (problem 1).

A reference is a value of a child table that names a row of a parent table. It is an orphan if no row of the parent
with that key exists at the time of the reference: never, no longer, or not yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.operators.skew import salted_join

#: Fixed pattern of node keys, after trimming and lower-casing.
NODE_KEY = "^(con|per|org|doc)-[0-9]{7}$"


def normal_key(c: Column | str) -> Column:
    """Trimmed of every kind of white space and lower-cased; null stays null."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s ]+|[\s ]+$", ""))


def document_references(documents: DataFrame) -> DataFrame:
    """(doc_id, field, node_key, ingested_at): the distinct node keys of metadata.entities, relations.source and
    relations.target. Null structs, arrays and elements, names and concept labels give no row."""
    base = documents.select("doc_id", "ingested_at", "metadata.entities", "metadata.relations")
    found = F.filter(
        F.flatten(F.array(
            F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda v: F.struct(F.lit("entities").alias("field"), v.alias("value"))),
            F.flatten(F.transform(
                F.filter(F.coalesce("relations", F.array().cast("array<struct<relation:string,source:string,target:string>>")), lambda r: r.isNotNull()),
                lambda r: F.array(F.struct(F.lit("source").alias("field"), r["source"].alias("value")), F.struct(F.lit("target").alias("field"), r["target"].alias("value"))),
            )),
        )),
        lambda x: x["value"].isNotNull(),
    )
    keyed = F.filter(F.transform(found, lambda x: F.struct(x["field"].alias("field"), normal_key(x["value"]).alias("node_key"))), lambda x: x["node_key"].rlike(NODE_KEY))
    return base.select("doc_id", "ingested_at", F.explode(F.array_distinct(keyed)).alias("r")).select("doc_id", "r.field", "r.node_key", "ingested_at")


def orphan_references(references: DataFrame, parents: DataFrame, key: str, parent_key: str, at: str | None = None,
                      since: str | None = None, until: str | None = None, row_id: str = "doc_id",
                      least: int = 100_000) -> DataFrame:
    """The rows of ``references`` whose non-null ``key`` has no row in ``parents``, with ``reason``.

    Without ``at``, existence is timeless. With it, a parent row exists in ``[since, until)``; a null bound is open, and
    a row whose until is not after its since never exists. reason is ``missing`` for keys no parent row has, ``absent``
    for keys that exist at other times. A null ``at`` compares with nothing, so only parents without that bound exist.

    Step one is a left anti-join of the distinct keys with the parent keys, so hot keys weigh as much as rare ones.
    Only references to keys that do exist take part in step two, an anti-join on key and time, salted for hot keys.
    Null keys give no row; repeated reference rows are kept; extra columns are carried along. references is read several
    times, so it should be a stored table.
    """
    refs = references.filter(F.col(key).isNotNull())
    rows = parents.filter(F.col(parent_key).isNotNull())
    known = rows.select(F.col(parent_key).alias(key)).distinct()
    missing = refs.select(key).distinct().join(known, key, "left_anti").withColumn("__missing", F.lit(True))
    marked = salted_join(refs, missing, [key], F.col(row_id), "left", least=least)
    never = marked.filter("__missing").drop("__missing").withColumn("reason", F.lit("missing"))
    if at is None:
        return never
    real = F.col("__since").isNull() | F.col("__until").isNull() | (F.col("__until") > F.col("__since"))
    spans = rows.select(F.col(parent_key).alias(key), F.col(since).alias("__since"), F.col(until).alias("__until")).distinct().filter(real)
    there = marked.filter("__missing IS NULL").drop("__missing")
    inside = (F.col("__since").isNull() | (F.col("__since") <= F.col(at))) & (F.col("__until").isNull() | (F.col("__until") > F.col(at)))
    absent = salted_join(there, spans, [key], F.col(row_id), "left_anti", where=inside, least=least)
    return never.unionByName(absent.withColumn("reason", F.lit("absent")))


def orphan_report(references: DataFrame, orphans: DataFrame, table: str, at: str) -> DataFrame:
    """(field, period, references, orphans): counts per ``table`` column and month of ``at``, also where none is orphan.

    Rows without a time have a null period."""
    period = F.date_format(F.date_trunc("month", F.col(at)), "yyyy-MM").alias("period")
    every = references.select(F.col(table), period, F.lit(0).alias("o")).groupBy(table, "period").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("o"))
    lost = orphans.select(F.col(table), period).groupBy(table, "period").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("o"))
    return every.unionByName(lost).groupBy(table, "period").agg(F.sum("n").alias("references"), F.sum("o").alias("orphans"))
