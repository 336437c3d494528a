"""Queries over the core operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkir.operators import orphans as O
from sparkir.session import stage


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = stage(O.document_references(table(spark, d, "documents")), "node-keys")
    nodes = table(spark, d, "nodes").select(O.normal_key("node_id").alias("parent_key"), "created_at", "deleted_at")
    return refs, O.orphan_references(refs, nodes, "node_key", "parent_key", "ingested_at", "created_at", "deleted_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_orphans(spark, d)[1].select("doc_id", "field", "node_key").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs, lost = p1_orphans(spark, d)
    return O.orphan_report(refs, lost, "field", "ingested_at")


P1_REFS = r"""
refs AS (
  SELECT DISTINCT doc_id, field, lower(trim(v)) AS node_key, ingested_at FROM (
    SELECT doc_id, 'entities' AS field, unnest(metadata.entities) AS v, ingested_at FROM documents
    UNION ALL
    SELECT doc_id, 'source', r.source, ingested_at FROM (SELECT doc_id, unnest(metadata.relations) AS r, ingested_at FROM documents)
    UNION ALL
    SELECT doc_id, 'target', r.target, ingested_at FROM (SELECT doc_id, unnest(metadata.relations) AS r, ingested_at FROM documents)
  ) WHERE regexp_full_match(lower(trim(v)), '(con|per|org|doc)-[0-9]{7}')
),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM nodes n WHERE lower(trim(n.node_id)) = r.node_key
      AND (n.created_at IS NULL OR n.created_at <= r.ingested_at) AND (n.deleted_at IS NULL OR n.deleted_at > r.ingested_at))
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

SQL = {
    "p1_found": f"WITH {P1_REFS} SELECT DISTINCT doc_id, field, node_key FROM orphans",
    "p1_report": f"""WITH {P1_REFS}
        SELECT field, strftime(date_trunc('month', ingested_at), '%Y-%m') AS period, CAST(sum(n) AS BIGINT) AS "references", CAST(sum(o) AS BIGINT) AS orphans
        FROM (SELECT field, ingested_at, 1 AS n, 0 AS o FROM refs UNION ALL SELECT field, ingested_at, 0, 1 FROM orphans) GROUP BY 1, 2""",
}
