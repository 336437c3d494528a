"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

A graph is sequential to build, so vectors are spread by hash over shards of bounded size, each shard is one graph, every
query searches all shards, and the k best of all are kept. Adding shards adds tasks, not work per task.

An index is a table, one row per vector: shard, vec_id, embedding, level, links (per layer the ids of the neighbours). It is
built once, stored, searched, loaded and changed; a search only reads it.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.vectors import METRICS
from sparkir.operators.ranking import ranked
from sparkir.session import stage


class SmallWorld:
    """The graph of one shard. Rows of ``x`` are nodes; distance is smaller for better under every metric."""

    def __init__(self, x: np.ndarray, m: int = 16, ef_construction: int = 200, metric: str = "cosine", seed: int = 0):
        self.m, self.ef, self.metric = checks.whole("m", m, 2), checks.whole("ef_construction", ef_construction, m), metric
        self.x = self._prepared(np.asarray(x, float))
        rng = np.random.default_rng(seed)
        self.levels = np.floor(-np.log(1 - rng.random(len(x))) / math.log(m)).astype(int)
        self.links: list[list[dict[int, float]]] = [[{} for _ in range(level + 1)] for level in self.levels]
        self.entry, self.removed = -1, set()
        for i in range(len(x)):
            self._insert(i)

    @classmethod
    def linked(cls, x: np.ndarray, levels: list[int], links: list[list[list[int]]], m: int, ef_construction: int, metric: str) -> SmallWorld:
        """A graph that has been built before, from the neighbours of each node per layer."""
        g = cls(np.empty((0, x.shape[1] if x.ndim == 2 else 1)), m, ef_construction, metric)
        g.x, g.levels = g._prepared(np.asarray(x, float)), np.asarray(levels, int)
        g.links = [[dict(zip(near, g._far(g.x[i], near).tolist())) if near else {} for near in layers] for i, layers in enumerate(links)]
        g.entry = int(np.lexsort((np.arange(len(x)), -g.levels))[0]) if len(x) else -1
        return g

    def add(self, x: np.ndarray, seed: int = 0) -> None:
        """Inserts further vectors behind the present ones."""
        x = self._prepared(np.asarray(x, float).reshape(len(x), -1))
        have = len(self.links)
        rng = np.random.default_rng((seed, have))
        levels = np.floor(-np.log(1 - rng.random(len(x))) / math.log(self.m)).astype(int)
        self.x = np.concatenate([self.x, x]) if have else x
        self.levels = np.concatenate([self.levels, levels]) if have else levels
        self.links += [[{} for _ in range(level + 1)] for level in levels]
        for i in range(have, have + len(x)):
            self._insert(i)

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        if not n.all():
            raise ValueError("a zero vector has no direction")
        return x / n

    def _far(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        y = self.x[ids]
        if self.metric == "euclidean":
            return np.sqrt(((y - q) ** 2).sum(1))
        return -(y @ q)

    def _layer(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes that a best-first walk from ``starts`` meets, nearest first."""
        seen = {i for _, i in starts}
        todo = list(starts)
        heapify(todo)
        best = [(-d, i) for d, i in starts]
        heapify(best)
        while todo:
            d, i = heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            seen.update(new)
            if new:
                for dj, j in zip(self._far(q, new), new):
                    if len(best) < ef or dj < -best[0][0]:
                        heappush(todo, (dj, j))
                        heappush(best, (-dj, j))
                        if len(best) > ef:
                            heappop(best)
        return sorted((-d, i) for d, i in best)

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Neighbours that are nearer to the node than to a chosen one, filled up with the nearest of the rest."""
        chosen: list[tuple[float, int]] = []
        rest = []
        for d, i in near:
            if len(chosen) >= most:
                break
            if chosen and self._far(self.x[i], [j for _, j in chosen]).min() < d:
                rest.append((d, i))
            else:
                chosen.append((d, i))
        return chosen + rest[: most - len(chosen)]

    def _insert(self, i: int) -> None:
        top = self.levels[i]
        if self.entry < 0:
            self.entry = i
            return
        q = self.x[i]
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        peak = self.levels[self.entry]
        for layer in range(peak, top, -1):
            at = self._layer(q, at, 1, layer)
        for layer in range(min(top, peak), -1, -1):
            at = self._layer(q, at, self.ef, layer)
            most = 2 * self.m if layer == 0 else self.m
            for d, j in self._diverse(at, self.m):
                self.links[i][layer][j] = d
                other = self.links[j][layer]
                other[i] = d
                if len(other) > most:
                    kept = dict((n, e) for e, n in self._diverse(sorted((e, n) for n, e in other.items()), most))
                    for n in set(other) - set(kept):
                        self.links[n][layer].pop(j, None)
                    self.links[j][layer] = kept
        if top > peak:
            self.entry = i

    def remove(self, i: int) -> None:
        """Unlinks a node; if it was the entry, the highest node left becomes it."""
        for layer, near in enumerate(self.links[i]):
            for j in near:
                self.links[j][layer].pop(i, None)
        self.links[i] = [{} for _ in self.links[i]]
        self.removed.add(i)
        if i == self.entry:
            left = [j for j in range(len(self.x)) if j not in self.removed]
            self.entry = max(left, key=lambda j: (self.levels[j], -j)) if left else -1

    def search(self, query: np.ndarray, k: int = 10, ef: int = 50) -> list[tuple[float, int]]:
        """(distance, node) of about the k nearest, nearest first."""
        if self.entry < 0:
            return []
        q = self._prepared(np.asarray(query, float))
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for layer in range(self.levels[self.entry], 0, -1):
            at = self._layer(q, at, 1, layer)
        return self._layer(q, at, max(ef, k), 0)[:k]

    def edges(self) -> list[tuple[int, int, int]]:
        return [(i, layer, j) for i, layers in enumerate(self.links) for layer, near in enumerate(layers) for j in sorted(near)]


INDEX = "shard int, vec_id string, embedding array<double>, level int, links array<array<string>>"


def _frame(shard: int, ids: list, x: np.ndarray, g: SmallWorld) -> pd.DataFrame:
    """The rows of a graph; removed nodes have none."""
    at = [i for i in range(len(ids)) if i not in g.removed]
    return pd.DataFrame({"shard": shard, "vec_id": [ids[i] for i in at], "embedding": [x[i] for i in at], "level": [int(g.levels[i]) for i in at],
                         "links": [[[ids[j] for j in sorted(near)] for near in g.links[i]] for i in at]})


def _graph(p: pd.DataFrame, m: int, ef_construction: int, metric: str) -> tuple[list, np.ndarray, SmallWorld]:
    ids = p["vec_id"].tolist()
    at = {v: i for i, v in enumerate(ids)}
    x = np.array(p["embedding"].tolist(), float)
    return ids, x, SmallWorld.linked(x, p["level"].tolist(), [[[at[n] for n in near if n in at] for near in layers] for layers in p["links"]], m, ef_construction, metric)


def build_index(store: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "cosine", seed: int = 0, shard_rows: int = 20_000) -> DataFrame:
    """The index of a store (vec_id, embedding), as described above. Lazily defined: keep it, by `session.stage` or
    `sources.store.save`, before it is searched more than once."""
    metric = checks.one_of("metric", metric, METRICS)
    n = max(1, -(-store.count() // shard_rows))
    rows = store.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id")
        x = np.array(p["embedding"].tolist(), float)
        return _frame(int(p["shard"].iloc[0]), p["vec_id"].tolist(), x, SmallWorld(x, m, ef_construction, metric, seed))

    return rows.groupBy("shard").applyInPandas(run, INDEX)


def index_edges(index: DataFrame) -> DataFrame:
    """(shard, node_id, layer, neighbor_id): the links as edges."""
    layers = index.select("shard", F.col("vec_id").alias("node_id"), F.posexplode("links").alias("layer", "near"))
    return layers.select("shard", "node_id", "layer", F.explode("near").alias("neighbor_id"))


def index_of(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """The index of vectors (vec_id, embedding) and their edges, as they were saved; a node without an edge is on layer 0 of
    shard 0, and a node's level is its highest layer with an edge."""
    near = edges.groupBy("shard", F.col("node_id").alias("vec_id"), "layer").agg(F.array_sort(F.collect_list("neighbor_id")).alias("near"))  # a node's degree is bounded
    layers = near.groupBy("vec_id").agg(F.min("shard").alias("shard"), F.max("layer").alias("level"), F.map_from_entries(F.collect_list(F.struct("layer", "near"))).alias("by"))
    none = F.array().cast("array<string>")
    out = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).join(layers, "vec_id", "left").na.fill(0, ["shard", "level"])
    return out.select("shard", "vec_id", "embedding", "level", F.transform(F.sequence(F.lit(0), "level"), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("by", lambda k, _: k == i)), F.lit(0)), none)).alias("links"))


def build_edges(store: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "cosine", seed: int = 0, shard_rows: int = 20_000) -> DataFrame:
    """(shard, node_id, layer, neighbor_id): the links of every shard's graph."""
    return index_edges(build_index(store, m, ef_construction, metric, seed, shard_rows))


def add_to_index(index: DataFrame, new: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "cosine", seed: int = 0) -> DataFrame:
    """The index with new vectors (vec_id, embedding) inserted into its graphs, spread over them by hash; an id that it has
    raises ValueError. Shards grow: rebuild where they outgrow a task. Into an empty index nothing is inserted but by
    building it."""
    metric = checks.one_of("metric", metric, METRICS)
    checks.none_left(new.join(index.select("vec_id"), "vec_id", "left_semi").select("vec_id"), "repeated vector id")
    checks.unique(new, "vec_id", "vector id")
    n = (index.agg(F.max("shard")).first()[0] or 0) + 1
    rows = new.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard"))

    def run(have: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        more = more.sort_values("vec_id")
        ids, x, g = _graph(have.sort_values("vec_id"), m, ef_construction, metric)
        if len(more):
            y = np.array(more["embedding"].tolist(), float)
            g.add(y, seed)
            ids, x = ids + more["vec_id"].tolist(), np.concatenate([x, y]) if len(x) else y
        return _frame(int((have if len(have) else more)["shard"].iloc[0]), ids, x, g)

    return index.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(run, INDEX)


def remove_from_index(index: DataFrame, ids: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "cosine") -> DataFrame:
    """The index without these ids (vec_id); their links go, everything else stays."""
    gone = index.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("shard").alias("shard"), F.col("vec_id").alias("vec_id"))

    def run(have: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        names, x, g = _graph(have.sort_values("vec_id"), m, ef_construction, metric)
        lost = set(out["vec_id"])
        for i, v in enumerate(names):
            if v in lost:
                g.remove(i)
        return _frame(int(have["shard"].iloc[0]), names, x, g)

    return index.groupBy("shard").cogroup(gone.groupBy("shard")).applyInPandas(run, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, ef_search: int = 50, metric: str = "cosine", block: int = 4096, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """(query_id, vec_id, score, rank) of about the k best vectors of a kept index for queries (query_id, embedding), ties by
    vec_id. A task has one graph and one block of queries; nothing is built, and no query passes the driver."""
    checks.whole("k", k)
    metric = checks.one_of("metric", metric, METRICS)
    checks.whole("ef_search", ef_search)
    kind = dict(queries.dtypes)["query_id"]
    blocks = max(1, -(-queries.count() // block))
    shards = index.select(F.col("shard").alias("shard")).distinct()
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("e"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).crossJoin(F.broadcast(shards))  # a row per shard of 20,000 vectors
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(p: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(p) and len(asked):
            ids, _, g = _graph(p.sort_values("vec_id"), m, ef_construction, metric)
            sign = 1.0 if metric == "euclidean" else -1.0
            found = [(qid, ids[i], round(sign * d, 9) + 0.0) for qid, e in zip(asked["query_id"], asked["e"]) for d, i in g.search(np.array(e), k, ef_search)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["shard", "block"]
    out = graphs.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(run, f"query_id {kind}, vec_id string, score double")
    return ranked(out, k, "vec_id", ascending=metric == "euclidean").select("query_id", "vec_id", "score", "rank")


def ann_search(store: DataFrame, queries: DataFrame, k: int = 10, m: int = 16, ef_construction: int = 200, ef_search: int = 50, metric: str = "cosine",
               seed: int = 0, removed: DataFrame | None = None, shard_rows: int = 20_000, block: int = 4096) -> DataFrame:
    """`search_index` over an index built of the store, without removed (vec_id), and kept for this search."""
    rows = store if removed is None else store.join(removed.select("vec_id"), "vec_id", "left_anti")
    index = stage(build_index(rows, m, ef_construction, metric, seed, shard_rows), "graphs")
    return search_index(index, queries, k, ef_search, metric, block, m, ef_construction)


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact k best (query_id, vec_id, rank) that were found."""
    e = exact.filter(F.col("rank") <= k).select("query_id", "vec_id")
    f = found.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return e.join(f, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
