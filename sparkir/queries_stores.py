"""Queries over what is kept and changed: vector stores, small-world indexes, graphs, saved indexes, and the whole engine, with
equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkir.operators import ann, dense, graph, index, lexical, ranking
from sparkir.plans.engine import SearchEngine
from sparkir.queries_engine import BASE, BM25, EMB, MATCH, PLAIN, PLAN, STAR, asked, corpus_graph, docs, idx, q_terms, r6, star_graph, store_of, table, vector_queries
from sparkir.session import shared_dir, stage
from sparkir.sources import store

LETTERS = "aeinrstol"


def letter_counts(text: Column) -> Column:
    """A deterministic embedding without a model: how often a text has each of a few letters, and one."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) + F.lit(1.0)) for c in LETTERS])


def cited(query: Column, context: Column) -> Column:
    """A deterministic generator: the length of what it was given."""
    return F.when(context.isNotNull(), F.concat(query, F.lit(": "), F.length(context).cast("string"), F.lit(" characters")))


def engine(spark: SparkSession, d: str) -> SearchEngine:
    every = table(spark, d, "documents").filter("trim(text) <> ''")
    return SearchEngine(every, PLAIN, embed=letter_counts, score=ranking.word_occurrences, generate=cited, index=idx(spark, d, True))


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}/saved-{uuid.uuid4().hex}"


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    s = store_of(spark, d)
    return s.filter("ord % 2 = 0"), s.filter("ord % 2 = 1")


def good(spark, d, found: DataFrame) -> DataFrame:
    """Whether the mean recall of approximate answers is at least 0.9, over so many queries."""
    recall = ann.recall_at_k(found, dense.exact_knn(store_of(spark, d), vector_queries(spark, d), 10), 10)
    return recall.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


def kept_index(spark, d, rows: DataFrame) -> DataFrame:
    return stage(ann.build_index(rows, ef_construction=80), "graphs")


def ann_recall(spark, d) -> DataFrame:
    return good(spark, d, ann.search_index(kept_index(spark, d, store_of(spark, d)), vector_queries(spark, d), 10, 80))


def ann_added(spark, d) -> DataFrame:
    one, two = halves(spark, d)
    grown = stage(ann.add_to_index(kept_index(spark, d, one), two, ef_construction=80), "graphs")
    return good(spark, d, ann.search_index(grown, vector_queries(spark, d), 10, 80))


def ann_loaded(spark, d) -> DataFrame:
    i, path = kept_index(spark, d, store_of(spark, d)), folder(spark)
    store.save(path, store_of(spark, d), 64, edges=ann.index_edges(i))
    vectors, edges, _ = store.load(spark, path)
    return good(spark, d, ann.search_index(stage(ann.index_of(vectors, edges), "graphs"), vector_queries(spark, d), 10, 80))


def ann_removed(spark, d) -> DataFrame:
    """No removed vector is found: the rest answers every query."""
    one, two = halves(spark, d)
    i = ann.remove_from_index(kept_index(spark, d, store_of(spark, d)), two)
    found = ann.search_index(stage(i, "graphs"), vector_queries(spark, d), 5, 80)
    return found.groupBy("query_id").agg(F.count("*").alias("found"), F.sum((F.col("vec_id").cast("long") % 2 == 1).cast("long")).alias("removed"))


def store_saved(spark, d) -> DataFrame:
    path = folder(spark)
    store.save(path, store_of(spark, d), 64)
    return store.load(spark, path)[0].select("vec_id", "ord", F.get_json_object("metadata", "$.label").alias("label"))


def index_saved(spark, d) -> DataFrame:
    path = folder(spark)
    idx(spark, d, True).write(path)
    return r6(lexical.search(asked(spark, d), index.Index.read(spark, path, PLAIN), "OR", 10))


def vector_add(spark, d) -> DataFrame:
    one, two = halves(spark, d)
    return dense.add_vectors(one, two.withColumn("vec_id", F.concat(F.lit(" "), "vec_id"))).select("vec_id", "ord")


def links_graph(spark, d) -> DataFrame:
    """The lowest layer of the stored small-world graph: cycles, hubs and parallel ways."""
    n = table(spark, d, "hnsw_nodes").filter("id IS NOT NULL").select(F.col("id").alias("src"), F.posexplode(F.get("neighbors", F.lit(0))).alias("ord", "dst")).filter("dst IS NOT NULL")
    return n.groupBy("src", "dst").agg(F.min("ord").cast("long").alias("ord"))


def links_bfs(spark, d) -> DataFrame:
    e = links_graph(spark, d)
    starts = e.select(F.col("src").alias("node_id")).distinct().select(F.col("node_id").alias("query_id"), "node_id")
    return graph.bfs(starts, e, 2)


def without_nations(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes, edges = star_graph(spark, d)
    return graph.remove_nodes(nodes, edges, nodes.filter("node_type = 'nation'"))


def grown_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """The star graph with a node per market segment, to which customers lead."""
    nodes, edges = star_graph(spark, d)
    c = table(spark, d, "customer")
    segment = F.concat(F.lit("segment-"), "c_mktsegment")
    nodes = graph.add_nodes(nodes, c.select(segment.alias("node_id")).distinct().select("node_id", F.lit("segment").alias("node_type"), F.lit("{}").alias("metadata")))
    more = c.select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("src"), segment.alias("dst"), F.lit("of").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"), (F.lit(1 << 40) + F.col("c_custkey")).alias("ord"))
    edges = graph.add_edges(nodes, edges, more)
    graph.check_graph(nodes, edges)
    return nodes, edges


def inexact(c: str) -> Column:
    return F.regexp_replace(c, "ish$", "")


WANTED = ("index", "indexish", "queryish", "zzzish")

QUERIES = {
    "ann_recall": ann_recall, "ann_added": ann_added, "ann_loaded": ann_loaded, "ann_removed": ann_removed,
    "store_saved": store_saved, "index_saved": index_saved, "vector_add": vector_add,
    "vector_get": lambda s, d: dense.get_vector(store_of(s, d), " 40 ").select("vec_id", "ord"),
    "vector_filter": lambda s, d: store_of(s, d).filter(dense.matches_filter({"label": 1.0}) & ~dense.matches_filter({"label": "1"})).select("vec_id"),
    "bm25_ranked": lambda s, d: r6(lexical.BM25Retriever(idx(s, d, True)).retrieve(q_terms(s, d))),
    "term_frequency_stem": lambda s, d: index.term_frequency(idx(s, d).postings, docs(s, d).select("doc_id", F.explode(F.array(*map(F.lit, WANTED))).alias("term")), inexact("term")),
    "doc_frequency_stem": lambda s, d: index.document_frequency(idx(s, d).frequencies, s.createDataFrame([(w,) for w in WANTED], "term string"), inexact("term")),
    "graph_links_bfs": links_bfs,
    "graph_adjacency": lambda s, d: r6(graph.adjacency(links_graph(s, d))),
    "graph_nodes_removed": lambda s, d: graph.degrees(*without_nations(s, d)),
    "graph_edges_removed": lambda s, d: graph.remove_edges(links_graph(s, d), links_graph(s, d).filter("src < dst")).select("src", "dst"),
    "graph_grown": lambda s, d: graph.degrees(*grown_graph(s, d)),
    "graph_values_match": lambda s, d: graph.match_nodes(asked(s, d), corpus_graph(s, d)[0].filter("node_type = 'entity'").withColumn("metadata", F.lit("{}")), values_only=True),
    "engine_search": lambda s, d: r6(engine(s, d).search(asked(s, d), "AND", 10)),
    "engine_dense": lambda s, d: r6(engine(s, d).dense.retrieve(asked(s, d), 10)),
    "engine_retrieve": lambda s, d: r6(engine(s, d).retrieve(asked(s, d), 10)),
    "engine_answer": lambda s, d: r6(engine(s, d).answer(asked(s, d), 5)),
}

_VECTOR = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) + 1 AS DOUBLE)" for c in LETTERS) + "]"
DENSE = f"""dv AS MATERIALIZED (SELECT doc_id, {_VECTOR.format('trim(text)')} AS v FROM docs WHERE trim(text) <> ''), dq AS (SELECT query_id, {_VECTOR.format('trim(text)')} AS w FROM q),
dtop AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(list_cosine_similarity(w, v), 9) AS score FROM dq, dv))"""
# the engine's documents are those with more than blanks
FUSED = "WITH " + BM25 + ", " + DENSE + ", " + MATCH.replace("FROM documents", "FROM docs0") + ", " + PLAN + """,
lists AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, rank FROM top JOIN cls USING (query_id) WHERE rank <= {0} AND contains(modes, 'lexical')
  UNION ALL SELECT query_id, CAST(doc_id AS VARCHAR), rank FROM dtop JOIN cls USING (query_id) WHERE rank <= {0} AND contains(modes, 'dense')
  UNION ALL SELECT query_id, document_id, rank FROM gtop JOIN cls USING (query_id) WHERE rank <= {0} AND contains(modes, 'graph')),
ff AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM lists GROUP BY 1, 2),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM ff)"""
FUSED = FUSED.replace("WITH ", "WITH docs0 AS (SELECT * FROM documents WHERE trim(text) <> ''), ", 1)
LINKS = "ln AS (SELECT id AS src, unnest(neighbors[1]) AS dst, generate_subscripts(neighbors[1], 1) - 1 AS ord FROM hnsw_nodes WHERE id IS NOT NULL), le AS MATERIALIZED (SELECT src, dst, min(ord) AS ord FROM ln WHERE dst IS NOT NULL GROUP BY 1, 2)"
_DEGREES = "o AS (SELECT src, count(*) AS c FROM {0} GROUP BY 1), i AS (SELECT dst, count(*) AS c FROM {0} GROUP BY 1) SELECT node_id, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM {1} LEFT JOIN o ON src = node_id LEFT JOIN i ON dst = node_id"
_W = ", ".join(f"('{w}')" for w in WANTED)
_RECALL = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0"

SQL = {
    "ann_recall": _RECALL, "ann_added": _RECALL, "ann_loaded": _RECALL,
    "ann_removed": "SELECT CAST(vec_id AS BIGINT) AS query_id, CAST(5 AS BIGINT) AS found, CAST(0 AS BIGINT) AS removed FROM embeddings WHERE vec_id % 20 = 0",
    "store_saved": "SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(vec_id AS BIGINT) AS ord, CAST(label AS VARCHAR) AS label FROM embeddings",
    "index_saved": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10",
    "vector_add": "WITH l AS (SELECT max(vec_id) AS m FROM embeddings WHERE vec_id % 2 = 0) SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE m + 1 + vec_id END AS BIGINT) AS ord FROM embeddings, l",
    "vector_get": "SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(vec_id AS BIGINT) AS ord FROM embeddings WHERE vec_id = 40",
    "vector_filter": "SELECT CAST(vec_id AS VARCHAR) AS vec_id FROM embeddings WHERE label = 1",
    "bm25_ranked": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top",
    "term_frequency_stem": f"WITH {BASE}, w(term) AS (VALUES {_W}) SELECT d.doc_id, w.term, coalesce(p.tf, s.tf, 0) AS tf FROM docs d CROSS JOIN w LEFT JOIN posts p ON p.doc_id = d.doc_id AND p.term = w.term LEFT JOIN posts s ON s.doc_id = d.doc_id AND s.term = regexp_replace(w.term, 'ish$', '')",
    "doc_frequency_stem": f"WITH {BASE}, w(term) AS (VALUES {_W}) SELECT w.term, coalesce(p.df, s.df, 0) AS df FROM w LEFT JOIN dfs p ON p.term = w.term LEFT JOIN dfs s ON s.term = regexp_replace(w.term, 'ish$', '')",
    "graph_links_bfs": f"WITH RECURSIVE {LINKS}, b AS (SELECT DISTINCT src AS query_id, src AS node_id, 0 AS depth FROM le UNION SELECT query_id, dst, depth + 1 FROM b JOIN le ON src = node_id WHERE depth < 2) SELECT query_id, node_id, min(depth) AS depth FROM b GROUP BY 1, 2",
    "graph_adjacency": f"WITH {LINKS} SELECT src, string_agg(dst, ',' ORDER BY ord, dst) AS neighbors FROM le GROUP BY 1",
    "graph_nodes_removed": f"WITH {STAR}, nodes AS (SELECT 'region-' || r_regionkey AS node_id FROM region UNION ALL SELECT 'customer-' || c_custkey FROM customer UNION ALL SELECT 'supplier-' || s_suppkey FROM supplier), left_over AS (SELECT * FROM edges WHERE NOT starts_with(src, 'nation-') AND NOT starts_with(dst, 'nation-')), " + _DEGREES.format("left_over", "nodes"),
    "graph_edges_removed": f"WITH {LINKS} SELECT src, dst FROM le WHERE src >= dst",
    "graph_grown": f"WITH {STAR}, nodes AS (SELECT 'region-' || r_regionkey AS node_id FROM region UNION ALL SELECT 'nation-' || n_nationkey FROM nation UNION ALL SELECT 'customer-' || c_custkey FROM customer UNION ALL SELECT 'supplier-' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT 'segment-' || c_mktsegment FROM customer), grown AS (SELECT src, dst FROM edges UNION ALL SELECT 'customer-' || c_custkey, 'segment-' || c_mktsegment FROM customer), " + _DEGREES.format("grown", "nodes"),
    "graph_values_match": f"WITH {MATCH}, vt AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(lower(node_id), '[a-z0-9]+')) AS token FROM entities) SELECT DISTINCT query_id, node_id FROM qtok JOIN vt USING (token)",
    "engine_search": f"WITH {BM25}, need AS (SELECT query_id, count(DISTINCT term) AS need FROM qt GROUP BY 1), f AS (SELECT bm.* FROM bm JOIN need USING (query_id) WHERE hits = need), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "engine_dense": f"WITH {BASE}, {DENSE} SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, round(score, 6) AS score, rank FROM dtop WHERE rank <= 10",
    "engine_retrieve": FUSED.replace("{0}", "50") + " SELECT query_id, document_id, round(score, 6) AS score, rank FROM fr WHERE rank <= 10",
    "engine_answer": FUSED.replace("{0}", "25") + """, ws AS (SELECT query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM q),
        sc AS (SELECT query_id, document_id, text, CAST(list_sum(list_transform(ws, lambda x: (length(lower(text)) - length(replace(lower(text), x, ''))) / length(x))) AS DOUBLE) AS score FROM fr JOIN docs ON CAST(doc_id AS VARCHAR) = document_id JOIN ws USING (query_id) WHERE rank <= 5),
        rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM sc),
        cx AS (SELECT query_id, string_agg('[SOURCE ' || rank || E']\\ndocument_id: ' || document_id || E'\\nretrieval_score: ' || printf('%.6f', score) || E'\\ntext:\\n' || text, E'\\n\\n' ORDER BY rank) AS context, string_agg(document_id, ',' ORDER BY rank) AS document_ids FROM rr GROUP BY 1)
        SELECT q.query_id, q.text || ': ' || length(context) || ' characters' AS answer, coalesce(document_ids, '') AS document_ids FROM q LEFT JOIN cx USING (query_id)""",
}
