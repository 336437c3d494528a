"""Saving and loading vector stores and neighbour graphs as a folder of Parquet tables with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.vectors import METRICS, valid_vector

VERSION = 1


def check_vectors(vectors: DataFrame, dimension: int) -> None:
    checks.unique(vectors, "vec_id", "vector id")
    checks.none_left(vectors.filter("vec_id IS NULL OR trim(vec_id) = ''"), "blank vector id")
    checks.none_left(vectors.filter(~valid_vector("embedding", dimension)).select("vec_id"), f"no vector of {dimension} finite numbers")


def check_edges(vectors: DataFrame, edges: DataFrame, m: int) -> None:
    """Edges (node_id, layer, neighbor_id) must join known nodes, no node to itself, and keep to the degree bound."""
    ids = vectors.select(F.col("vec_id"))
    for side in ("node_id", "neighbor_id"):
        checks.none_left(edges.join(ids, F.col(side) == F.col("vec_id"), "left_anti"), f"{side} is not in the store")
    checks.none_left(edges.filter("node_id = neighbor_id OR layer < 0"), "invalid edge")
    over = edges.groupBy("node_id", "layer").count().filter(F.col("count") > F.when(F.col("layer") == 0, 2 * m).otherwise(m))
    checks.none_left(over, "too many neighbours")


def save(path: str, vectors: DataFrame, dimension: int, metric: str = "cosine", edges: DataFrame | None = None, m: int = 16) -> None:
    """Checks everything first, then overwrites the folder; the manifest is written last, so a broken save has none."""
    checks.one_of("metric", metric, METRICS)
    check_vectors(vectors, dimension)
    if edges is not None:
        check_edges(vectors, edges, m)
    spark = vectors.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    if edges is not None:
        edges.write.mode("overwrite").parquet(f"{path}/edges")
    manifest = spark.createDataFrame([(VERSION, dimension, metric, edges is not None, m)], "version int, dimension int, metric string, has_edges boolean, m int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, DataFrame | None, dict]:
    """(vectors, edges or None, manifest). ValueError for an unknown version or, with validate, broken invariants."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    if manifest["version"] != VERSION:
        raise ValueError(f"unknown version {manifest['version']}")
    vectors = spark.read.parquet(f"{path}/vectors")
    edges = spark.read.parquet(f"{path}/edges") if manifest["has_edges"] else None
    if validate:
        check_vectors(vectors, manifest["dimension"])
        if edges is not None:
            check_edges(vectors, edges, manifest["m"])
    return vectors, edges, manifest
