"""Vector stores as tables (vec_id, ord, embedding, metadata), and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.vectors import METRICS, valid_vector
from sparkir.operators.ranking import ranked


def dimension_of(vectors: DataFrame) -> int | None:
    """The length of the first vector by ord; None for an empty store."""
    row = vectors.filter("embedding IS NOT NULL").orderBy("ord").select(F.size("embedding")).first()
    return row[0] if row else None


def add_vectors(store: DataFrame, new: DataFrame, dimension: int | None = None) -> DataFrame:
    """The store with new rows (vec_id, embedding, metadata) behind its own, all or none: a blank or repeated id, or a
    vector of another dimension or with a non-finite number, raises ValueError. Ids are trimmed."""
    dimension = dimension or dimension_of(store)
    new = new.withColumn("vec_id", F.trim("vec_id"))
    checks.none_left(new.filter("vec_id IS NULL OR vec_id = ''"), "blank vector id")
    checks.none_left(new.filter(~valid_vector("embedding", dimension)).select("vec_id"), "invalid vector")
    last = store.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    if "ord" not in new.columns:
        new = new.withColumn("ord", F.lit(last) + 1 + F.monotonically_increasing_id())
    else:
        new = new.withColumn("ord", F.lit(last) + 1 + F.col("ord"))
    return checks.unique(store.unionByName(new.select(*store.columns)), "vec_id", "vector id")


def update_vectors(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes (vec_id, embedding, metadata) replace embedding and metadata where not null; ids must exist."""
    checks.none_left(changes.join(store.select("vec_id"), "vec_id", "left_anti"), "unknown vector id", KeyError)
    checks.none_left(changes.filter("embedding IS NULL AND metadata IS NULL"), "nothing to change")
    c = changes.select("vec_id", F.col("embedding").alias("__e"), F.col("metadata").alias("__m"))
    kind = store.schema["embedding"].dataType
    out = store.join(c, "vec_id", "left").withColumn("embedding", F.coalesce(F.col("__e").cast(kind), "embedding")).withColumn("metadata", F.coalesce("__m", "metadata"))
    return out.select(*store.columns)


def delete_vectors(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without these ids; KeyError for one that it lacks."""
    checks.none_left(ids.join(store.select("vec_id"), "vec_id", "left_anti"), "unknown vector id", KeyError)
    return store.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def get_vector(store: DataFrame, vec_id: str) -> DataFrame:
    row = store.filter(F.col("vec_id") == checks.text("vec_id", vec_id).strip())
    if row.isEmpty():
        raise KeyError(vec_id)
    return row


def matches_filter(wanted: dict, metadata: str = "metadata") -> Column:
    """Whether all entries equal those of a JSON metadata column as typed values; a missing key equals None.

    1 equals 1.0 and true, as in Python, but not "1"; lists equal lists of equal members, objects objects of equal entries in
    any order. A row whose metadata is null or no JSON object has no keys.
    """
    on = F.lit(True)
    for key, value in wanted.items():
        checks.text("metadata key", key)
        on = on & _equals(F.try_parse_json(F.col(metadata)), f"$['{key}']", value)
    return on


def _equals(json: Column, path: str, value) -> Column:
    at = F.try_variant_get(json, path, "variant")
    kind = F.coalesce(F.schema_of_variant(at), F.lit("VOID"))
    if value is None:
        return kind == "VOID"
    if isinstance(value, (bool, int, float)):
        number = F.coalesce(F.try_variant_get(json, path, "double"), F.lit(float("nan")))
        as_bool = F.coalesce(F.try_variant_get(json, path, "boolean").cast("int").cast("double"), F.lit(float("nan")))
        is_number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
        return F.coalesce(F.when(kind == "BOOLEAN", as_bool == float(value)).when(is_number, number == float(value)).otherwise(False), F.lit(False))
    if isinstance(value, str):
        return (kind == "STRING") & F.coalesce(F.try_variant_get(json, path, "string") == value, F.lit(False))
    members = F.try_variant_get(json, path, "array<variant>" if isinstance(value, (list, tuple)) else "map<string,variant>")
    same = F.coalesce(F.size(members) == len(value), F.lit(False))
    parts = [(f"{path}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, (list, tuple)) else [(f"{path}['{k}']", v) for k, v in value.items()]
    for inner, v in parts:
        same = same & _equals(json, inner, v)
    return same


#: Values of query vectors that are sent to every task of the store: some megabytes. More meet the store in blocks.
SENT = 1 << 22
#: Scores that are looked at at a time.
CELL = 1 << 22


def exact_knn(store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", where: Column | None = None, block: int | None = None, part_rows: int = 200_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of the store for each of queries (query_id, embedding).

    Cosine and dot go down, euclidean goes up; ties by ord, then id. ``where`` filters the store before anything is
    scored. A vector of another dimension, or a zero vector under cosine, fails the query, as an empty store gives no rows.

    Up to ``block`` queries (by default as many as have SENT values, or places in the answer) go to every task, which scans its part of the store once with matrix products and keeps k rows per
    query, so k x tasks rows per query are shuffled, not all pairs. More queries are cut into blocks and the store into parts of
    about ``part_rows``; every block meets every part in a task of its own, without the driver.
    """
    checks.whole("k", k)
    metric = checks.one_of("metric", metric, METRICS)
    rows = store if where is None else store.filter(where)
    rows = rows.select("vec_id", "ord", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, vec_id string, ord long, score double"
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    if block is None:
        one = q.first()
        block = max(1, SENT // max(1, len(one.e or ()), k)) if one else 1
    held = q.limit(block + 1).collect()  # a bounded number
    if not held:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, vec_id string, score double, rank int")
    if len(held) <= block:
        shared = rows.sparkSession.sparkContext.broadcast(([r.query_id for r in held], _checked(np.array([r.e for r in held], dtype=float), metric)))
        out = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).mapInArrow(lambda batches: _best(shared.value, batches, k, metric), schema)
    else:
        total, size = q.count(), rows.count()
        blocks, parts = -(-total // block), max(1, -(-size // part_rows))
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(asked: pa.Table, part: pa.Table) -> pa.Table:
            empty = pa.table({"query_id": asked.column("query_id")[:0], "vec_id": pa.array([], pa.string()), "ord": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not asked.num_rows or not part.num_rows:
                return empty
            wanted = _checked(np.array(asked.column("e").to_pylist(), dtype=float), metric)
            batches = part.select(["vec_id", "ord", "embedding"]).combine_chunks().to_batches(max_chunksize=10_000)
            found = list(_best((asked.column("query_id").to_pylist(), wanted), iter(batches), k, metric))
            return pa.Table.from_batches(found).cast(empty.schema) if found else empty

        out = q.groupBy("part", "block").cogroup(rows.groupBy("part", "block")).applyInArrow(meet, schema)
    out = ranked(out.withColumn("tie", F.struct("ord", "vec_id")), k, "tie", ascending=metric == "euclidean")
    return out.select("query_id", "vec_id", "score", "rank")


def _checked(wanted: np.ndarray, metric: str) -> np.ndarray:
    if wanted.ndim != 2 or not np.isfinite(wanted).all():
        raise ValueError("query vectors must be of one dimension and finite")
    if metric == "cosine" and not np.linalg.norm(wanted, axis=1).all():
        raise ValueError("a zero vector has no direction")
    return wanted


def _best(asked: tuple[list, np.ndarray], batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, ord, score): the k best rows of the batches for each query, some queries at a time."""
    ids, wanted = asked
    size = np.linalg.norm(wanted, axis=1)
    score, place, name = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -1, np.int64)
    names: list[str] = []
    for b in batches:
        if not b.num_rows:
            continue
        e = b.column("embedding")
        if e.null_count or set(e.value_lengths().to_numpy(zero_copy_only=False)) != {wanted.shape[1]}:
            raise ValueError("vectors must have the dimension of the queries")
        x = e.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        norm = np.linalg.norm(x, axis=1)
        if metric == "cosine" and not norm.all():
            raise ValueError("a zero vector has no direction")
        first, order = len(names), b.column("ord").to_numpy(zero_copy_only=False)
        names += b.column("vec_id").to_pylist()
        for lo in range(0, len(ids), per := max(1, CELL // b.num_rows)):
            w = wanted[lo : lo + per]
            s = w @ x.T
            if metric == "cosine":
                s /= size[lo : lo + per, None] * norm[None, :]
            elif metric == "euclidean":
                s = -np.sqrt(np.maximum((w**2).sum(1)[:, None] - 2 * s + (x**2).sum(1)[None, :], 0))
            bar = score[lo : lo + per, -1].copy()  # anything not worse than the k-th so far stays in the running
            open_ = bar == -np.inf
            if open_.any() and b.num_rows > k:
                bar[open_] = np.partition(s[open_], b.num_rows - k, axis=1)[:, b.num_rows - k]
            i, j = np.nonzero(s >= bar[:, None] - 2e-9)
            if not len(i):
                continue
            who = np.unique(i)
            old = name[lo + who] >= 0
            q = np.concatenate([np.repeat(who, old.sum(1)), i])
            v = np.concatenate([score[lo + who][old], np.round(s[i, j], 9)])
            o, n = np.concatenate([place[lo + who][old], order[j]]), np.concatenate([name[lo + who][old], first + j])
            by = np.lexsort((o, -v, q))
            if ((np.diff(q[by]) == 0) & (np.diff(v[by]) == 0) & (np.diff(o[by]) == 0)).any():  # ids decide
                by = np.array(sorted(by, key=lambda t: (q[t], -v[t], o[t], names[n[t]])))
            q, v, o, n = q[by], v[by], o[by], n[by]
            at = np.arange(len(q))
            rank = at - np.maximum.accumulate(np.where(np.concatenate([[True], q[1:] != q[:-1]]), at, 0))
            q, v, o, n, rank = (c[rank < k] for c in (q, v, o, n, rank))
            score[lo + q, rank], place[lo + q, rank], name[lo + q, rank] = v, o, n
    sign, kept, known = -1.0 if metric == "euclidean" else 1.0, name >= 0, pa.array(ids)
    for lo in range(0, len(ids), per := max(1, 100_000 // k)):
        own = kept[lo : lo + per]
        if own.any():
            q, c = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(lo + q)), pa.array([names[t] for t in name[lo + q, c]], pa.string()), pa.array(place[lo + q, c], pa.int64()), pa.array(sign * score[lo + q, c] + 0.0)], names=["query_id", "vec_id", "ord", "score"])


def embed_documents(documents: DataFrame, embed) -> DataFrame:
    """(vec_id, ord, embedding, metadata) of documents with a text, by a column function as `providers.embed_column` gives it."""
    return documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("vec_id"), F.col("doc_id").alias("ord"), embed(F.trim("text")).alias("embedding"), F.lit(None).cast("string").alias("metadata"))


class DenseRetriever:
    """Documents and queries embedded by one model, and exact nearest neighbours among them."""

    def __init__(self, store: DataFrame, embed, metric: str = "cosine"):
        self.store, self.embed, self.metric = store, embed, checks.one_of("metric", metric, METRICS)

    @classmethod
    def from_documents(cls, documents: DataFrame, embed, metric: str = "cosine") -> DenseRetriever:
        return cls(embed_documents(documents, embed), embed, metric)

    def retrieve(self, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
        """(query_id, document_id, score, rank) for queries (query_id, text)."""
        asked = queries.select("query_id", self.embed(F.trim("text")).alias("embedding"))
        return exact_knn(self.store, asked, k, self.metric, where).withColumnRenamed("vec_id", "document_id")


VectorRetriever = DenseRetriever
