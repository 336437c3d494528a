"""Property graphs as tables: nodes (node_id, node_type, metadata) and edges (src, dst, edge_type, weight, metadata, ord).

Edges are directed and may be parallel. metadata is JSON text.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.text import ascii_tokens
from sparkir.operators.ranking import ranked
from sparkir.session import cut, stage


def check_graph(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises for blank or repeated node ids, blank types (ValueError), and for edges without their nodes (KeyError)."""
    checks.none_left(nodes.filter("node_id IS NULL OR trim(node_id) = '' OR node_type IS NULL OR trim(node_type) = ''"), "a node needs an id and a type")
    checks.unique(nodes, "node_id", "node id")
    checks.none_left(edges.filter("edge_type IS NULL OR trim(edge_type) = ''"), "an edge needs a type")
    for side in ("src", "dst"):
        checks.none_left(edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_anti").select("src", "dst"), f"unknown {side}", KeyError)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return checks.unique(nodes.unionByName(new), "node_id", "node id")


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        checks.none_left(new.join(nodes.select(F.col("node_id").alias(side)), side, "left_anti").select("src", "dst"), f"unknown {side}", KeyError)
    return edges.unionByName(new)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes (node_id) and without every edge from or to them, so none is left dangling."""
    gone = ids.select("node_id").distinct()
    left = edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.select(*edges.columns)


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    row = nodes.filter(F.col("node_id") == node_id)
    if row.isEmpty():
        raise KeyError(node_id)
    return row


def outgoing(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """The edges that leave these nodes (node_id), parallel ones included; order them by ord."""
    return edges.join(node_ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming) of every node."""
    o = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("outgoing"))
    i = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("incoming"))
    return nodes.select("node_id").join(o, "node_id", "left").join(i, "node_id", "left").na.fill(0)


def bfs(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(query_id, node_id, depth): the nodes reached from starts (query_id, node_id), at their least depth, 0 for starts.

    Many starts of one query are one search, so depth is the distance to the nearest. Each hop joins only the newest
    frontier with the edges and drops what was visited; it ends at max_depth or when a hop finds nothing new. Only outgoing
    edges are followed. The distinct edges are stored once, not derived anew at each hop; a hub in many frontiers is
    left to adaptive execution, which splits its partition.
    """
    if max_depth is not None:
        checks.whole("max_depth", max_depth, 0)
    hop = stage(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct(), "hops")
    frontier = cut(starts.select("query_id", "node_id").distinct())
    seen, parts, depth = frontier, [frontier.withColumn("depth", F.lit(0))], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        found = frontier.join(hop, "node_id").select("query_id", F.col("next").alias("node_id")).distinct()
        frontier = cut(found.join(seen, ["query_id", "node_id"], "left_anti"))
        parts.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def k_hop(starts: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, depth) of the nodes within k hops, the starts left out."""
    return bfs(starts, edges, checks.whole("k", k, 0)).filter("depth > 0")


def dfs(starts: DataFrame, edges: DataFrame, max_depth: int | None = None, most: int = 1_000_000) -> DataFrame:
    """(query_id, step, node_id, depth): depth-first order per start (query_id, node_id), one start per query_id.

    Neighbours are visited in order of ord, a node is marked when it is put on the stack, and depth is that of the path it
    was put there by. The order is sequential by nature, so the edges that a start can reach are gathered for it; a start with
    more than ``most`` of them raises ValueError before that: bound max_depth then.
    """
    reach = bfs(starts, edges, max_depth)
    local = stage(reach.select("query_id", F.col("node_id").alias("src")).join(edges.select("src", "dst", "ord"), "src"), "reached")
    checks.none_left(local.groupBy("query_id").count().filter(F.col("count") > most).select("query_id"), f"more than {most} edges within reach")
    roots = starts.select("query_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(-1).cast("long").alias("ord"))

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ord", "dst"])
        root = p.loc[p["ord"] < 0, "src"].iloc[0]
        after = {s: g["dst"].tolist() for s, g in p[p["ord"] >= 0].groupby("src")}
        seen, stack, out = {root}, deque([(root, 0)]), []
        while stack:
            node, depth = stack.pop()
            out.append((node, depth))
            if max_depth is None or depth < max_depth:
                for n in reversed(after.get(node, [])):
                    if n not in seen:
                        seen.add(n)
                        stack.append((n, depth + 1))
        return pd.DataFrame({"query_id": p["query_id"].iloc[0], "step": range(len(out)), "node_id": [n for n, _ in out], "depth": [d for _, d in out]})

    kind = dict(starts.dtypes)["query_id"]
    return local.select("query_id", "src", "dst", F.col("ord").cast("long")).unionByName(roots).groupBy("query_id").applyInPandas(walk, f"query_id {kind}, step int, node_id string, depth int")


def node_tokens(nodes: DataFrame, values_only: bool = False) -> DataFrame:
    """(node_id, token) of id, type and metadata. Keys of the metadata and the type are words of the node too; values_only
    leaves the type and the keys of the outer object out."""
    # the values alone come out of a map; the whole text holds keys and values, whose punctuation is no token
    meta = F.concat_ws(" ", F.map_values(F.from_json("metadata", "map<string,string>"))) if values_only else F.col("metadata")
    text = F.concat_ws(" ", "node_id", meta) if values_only else F.concat_ws(" ", "node_id", "node_type", meta)
    return nodes.select("node_id", F.explode(ascii_tokens(text)).alias("token"))


def match_nodes(queries: DataFrame, nodes: DataFrame, document_type: str = "document", values_only: bool = False) -> DataFrame:
    """(query_id, node_id): nodes other than documents that share a token with the query."""
    q = queries.select("query_id", F.explode(ascii_tokens("text")).alias("token"))
    n = node_tokens(nodes.filter((F.col("node_type") != document_type) | F.col("node_type").isNull()), values_only)
    return q.join(n, "token").select("query_id", "node_id").distinct()


def near_documents(starts: DataFrame, edges: DataFrame, documents: DataFrame, top_k: int, max_hops: int) -> DataFrame:
    """(query_id, node_id, depth): of each query's starts (query_id, node_id) the top_k of documents (node_id) within max_hops,
    by depth and id. A query that has them is not followed any farther, as what comes later is deeper."""
    hop = stage(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct(), "hops")
    frontier = stage(starts.select("query_id", "node_id").distinct(), "frontier")
    seen, out = frontier, None
    for depth in range(max_hops + 1):
        if depth:
            found = frontier.join(hop, "node_id").select("query_id", F.col("next").alias("node_id")).distinct()
            frontier = stage(found.join(seen, ["query_id", "node_id"], "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id"))
        here = frontier.join(documents, "node_id", "left_semi").withColumn("r", first).filter(F.col("r") <= top_k)
        here = stage(here.select("query_id", "node_id", F.lit(depth).alias("depth")), "near")
        out = here if out is None else out.unionByName(here)
        if depth < max_hops:
            enough = out.groupBy("query_id").count().filter(F.col("count") >= top_k)
            frontier = frontier.join(enough, "query_id", "left_anti")
    if out is None:
        return starts.select("query_id", "node_id", F.lit(0).alias("depth")).limit(0)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "node_id"))
    return out.withColumn("r", best).filter(F.col("r") <= top_k).drop("r")


def graph_retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 10, max_hops: int = 2, starts: DataFrame | None = None,
                   document_type: str = "document", values_only: bool = False) -> DataFrame:
    """(query_id, document_id, score, rank): documents within max_hops of a matching node, by 1 / (hops + 1).

    starts (node_id) restricts the matching nodes. Ties: the smaller id as a string.

    The search goes by token, not by query: of a query's best documents each is as near to one of its tokens, and as what is
    better for that token is better for the query, it is among the token's best. So only those meet the queries.
    """
    checks.whole("top_k", top_k)
    asked = queries.select("query_id", F.explode(ascii_tokens("text")).alias("token"))
    named = node_tokens(nodes.filter((F.col("node_type") != document_type) | F.col("node_type").isNull()), values_only)
    begin = named.join(asked.select("token").distinct(), "token", "left_semi").select(F.col("token").alias("query_id"), "node_id")
    if starts is not None:
        begin = begin.join(starts.select("node_id").distinct(), "node_id", "left_semi")
    docs = nodes.filter(F.col("node_type") == document_type).select("node_id")
    near = near_documents(begin, edges, docs, top_k, max_hops).withColumnRenamed("query_id", "token")
    hit = asked.join(near, "token").groupBy("query_id", F.col("node_id").alias("document_id")).agg(F.min("depth").alias("depth"))
    return ranked(hit.select("query_id", "document_id", (F.lit(1.0) / (F.col("depth") + 1)).alias("score")), top_k, "document_id")


def normal_value(c: Column) -> Column:
    """Text of a value, trimmed; empty for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def build_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc_id, text, metadata<topic, entities, relations>).

    Every document and every entity name is a node; an entity leads to each document that lists it (mentioned_in, once),
    and the source of a relation to its target. A missing source is the document's first entity; relations without name,
    target or any source are left out. Of several relations between two nodes the first by (name, doc_id) counts. An
    entity that a document lists carries the id of the first such document, one that only relations name those of all.
    """
    m = documents.select("doc_id", "text", "metadata.topic", F.coalesce("metadata.entities", F.array().cast("array<string>")).alias("entities"), "metadata.relations")
    names = F.filter(F.transform("entities", lambda e: normal_value(e)), lambda e: e != "")
    m = m.withColumn("entities", names)
    doc_meta = F.to_json(F.struct(F.col("doc_id").alias("document_id"), "text", "topic", F.lit("documents").alias("source")))
    doc_nodes = m.select(F.col("doc_id").cast("string").alias("node_id"), F.lit("document").alias("node_type"), doc_meta.alias("metadata"))
    listed = m.select("doc_id", F.explode(F.array_distinct("entities")).alias("name"))
    r = m.filter(F.size("relations") > 0).select("doc_id", F.get("entities", F.lit(0)).alias("first"), F.explode("relations").alias("r")).filter("r IS NOT NULL")
    r = r.select("doc_id", normal_value(F.col("r.relation")).alias("relation"), normal_value(F.col("r.source")).alias("s"), "first", normal_value(F.col("r.target")).alias("dst"))
    r = r.withColumn("src", F.when(F.col("s") != "", F.col("s")).otherwise(F.coalesce("first", F.lit("")))).filter("relation <> '' AND dst <> '' AND src <> ''")
    first = listed.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    by_list = first.select(F.col("name").alias("node_id"), F.lit("entity").alias("node_type"), F.to_json(F.struct("name", F.array("doc_id").alias("document_ids"), F.array("doc_id").alias("source_documents"))).alias("metadata"))
    ends = r.select(F.col("src").alias("name"), "doc_id").union(r.select(F.col("dst").alias("name"), "doc_id")).distinct()
    only = ends.join(first.select("name"), "name", "left_anti").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("documents"))
    by_relation = only.select(F.col("name").alias("node_id"), F.lit("entity").alias("node_type"), F.to_json(F.struct("name", F.array("doc_id").alias("document_ids"), "documents")).alias("metadata"))
    entity_nodes = by_list.unionByName(by_relation)
    # a name that equals a document's id is that document's node
    entity_nodes = entity_nodes.join(doc_nodes.select("node_id"), "node_id", "left_anti")
    mentions = listed.select(F.col("name").alias("src"), F.col("doc_id").cast("string").alias("dst"), F.lit("mentioned_in").alias("edge_type"), F.to_json(F.struct(F.col("doc_id").alias("document_id"), F.lit("metadata.entities").alias("source"))).alias("metadata"), F.col("doc_id").alias("at"), F.lit(0).alias("k"))
    related = r.groupBy("src", "dst").agg(F.min(F.struct("relation", "doc_id")).alias("e"))
    related = related.join(mentions.select("src", "dst"), ["src", "dst"], "left_anti")
    related = related.select("src", "dst", F.col("e.relation").alias("edge_type"), F.to_json(F.struct(F.col("e.doc_id").alias("document_id"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("metadata"), F.col("e.doc_id").alias("at"), F.lit(1).alias("k"))
    edges = mentions.unionByName(related)
    # a stable order without a global sort: mentions by document, then relations; edges of one document go by their end
    order = F.col("at") + F.col("k") * F.lit(1 << 62)
    return doc_nodes.unionByName(entity_nodes), edges.select("src", "dst", "edge_type", F.lit(1.0).alias("weight"), "metadata", order.alias("ord"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbors): neighbours in order of ord, parallel ones repeated; a row only for nodes with outgoing edges."""
    return edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda e: e["dst"]).alias("neighbors"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge by ord of every pair of nodes."""
    return edges.withColumn("__i", F.row_number().over(Window.partitionBy("src", "dst").orderBy("ord", "edge_type"))).filter("__i = 1").drop("__i")
