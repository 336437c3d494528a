"""Queries over the retrieval operators, with equivalent SQL. Doubles are rounded to six digits, arrays joined to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkir.functions import text as X
from sparkir.functions import vectors as V
from sparkir.functions.text import STOPWORDS, Analyzer
from sparkir.operators import ann, dense, evaluation, graph, index, lexical, matching, ranking, toy
from sparkir.plans import hybrid, planning, rag
from sparkir.sources import corpus

PLAIN = Analyzer(stem=False)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")


def asked(spark, d):
    return table(spark, d, "queries").filter("trim(text) <> ''").select("query_id", "text")


def idx(spark, d, store: bool = False) -> index.Index:
    return index.build_index(docs(spark, d), PLAIN, store)


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def q_terms(spark, d):
    return matching.query_terms(asked(spark, d), PLAIN)


def run_of(spark, d) -> DataFrame:
    """The lexical list of every query, as a run."""
    r = table(spark, d, "results").filter("signal = 'lexical' AND score IS NOT NULL AND NOT isnan(score)")
    return ranking.ranked(r.groupBy("query_id", "document_id").agg(F.max("score").alias("score")), None, "document_id")


def qrels_of(spark, d) -> DataFrame:
    """A document is judged by how many other signals found it."""
    r = table(spark, d, "results").filter("score IS NOT NULL AND NOT isnan(score)")
    return r.groupBy("query_id", "document_id").agg((F.count_distinct("signal") - 1).cast("double").alias("relevance"))


def signals_of(spark, d) -> DataFrame:
    r = table(spark, d, "results").filter("score IS NOT NULL AND NOT isnan(score)")
    return r.groupBy("query_id", "signal", F.col("document_id").cast("long").alias("doc_id")).agg(F.max("score").alias("score"))


def lists_of(spark, d) -> DataFrame:
    s = signals_of(spark, d).select("query_id", F.col("signal").alias("list"), F.col("doc_id").cast("string").alias("document_id"), "score")
    return ranking.ranked(s, None, "document_id", by=("query_id", "list"))


def store_of(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("vec_id").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"), F.to_json(F.struct("label")).alias("metadata"))


def vector_queries(spark, d) -> DataFrame:
    return store_of(spark, d).filter("ord % 20 = 0").select(F.col("ord").alias("query_id"), "embedding")


def star_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """region, nation, customer and supplier as nodes; each leads to what it belongs to."""
    parts = [("region", "r_regionkey", None, None), ("nation", "n_nationkey", "n_regionkey", "region"), ("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation")]
    nodes = edges = None
    for kind, key, up, to in parts:
        t = table(spark, d, kind)
        n = t.select(F.concat(F.lit(kind + "-"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), F.lit("{}").alias("metadata"))
        nodes = n if nodes is None else nodes.unionByName(n)
        if up:
            e = t.select(F.concat(F.lit(kind + "-"), F.col(key).cast("string")).alias("src"), F.concat(F.lit(to + "-"), F.col(up).cast("string")).alias("dst"), F.lit("in").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"), F.col(key).cast("long").alias("ord"))
            edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


def star_starts(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("query_id"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("node_id"))


def corpus_graph(spark, d):
    return graph.build_graph(table(spark, d, "documents"))


def lexical_retriever(i):
    return lambda q, k: lexical.search(q, i, "OR", k).withColumnRenamed("doc_id", "document_id")


def reranked(spark, d) -> DataFrame:
    found = lexical.search(asked(spark, d), idx(spark, d, True), "OR", 10).withColumnRenamed("doc_id", "document_id")
    return ranking.cross_rerank(found, asked(spark, d), docs(spark, d), ranking.word_occurrences, 5)


def found_evidence(spark, d) -> DataFrame:
    found = lexical.search(asked(spark, d), idx(spark, d, True), "OR", 5).withColumnRenamed("doc_id", "document_id")
    return rag.evidence(found.withColumn("score", F.round("score", 6)), docs(spark, d))


def vector_metrics(spark, d) -> DataFrame:
    q = vector_queries(spark, d).withColumnRenamed("embedding", "q")
    pairs = store_of(spark, d).join(q, F.col("ord") == F.col("query_id") + 1)
    scaled = F.transform("embedding", lambda x: x * 3.0)
    return r6(pairs.select("query_id", V.dot("q", scaled).alias("dot"), V.cosine("q", scaled).alias("cosine"), V.euclidean("q", scaled).alias("euclidean"), V.norm(scaled).alias("norm"), V.cosine("q", F.transform("embedding", lambda x: x * 0.0), "zero").alias("zero")))


def analysis(spark, d) -> DataFrame:
    a = planning.analyze(asked(spark, d))
    return r6(a.drop("text"))


def updated(spark, d) -> DataFrame:
    s = store_of(spark, d)
    changes = s.filter("ord % 50 = 0").select("vec_id", F.lit(None).cast("array<double>").alias("embedding"), F.lit('{"label":-1}').alias("metadata"))
    return dense.update_vectors(s, changes).select("vec_id", F.get_json_object("metadata", "$.label").alias("label"))


def hybrid_run(spark, d) -> DataFrame:
    nodes, edges = corpus_graph(spark, d)
    h = hybrid.HybridRetriever({"lexical": lexical_retriever(idx(spark, d, True)), "graph": lambda q, k: graph.graph_retrieve(q, nodes, edges, k)})
    return h.retrieve(asked(spark, d), 10)


def score_sorted(spark, d) -> DataFrame:
    s = signals_of(spark, d).filter("signal = 'graph'").select("query_id", "doc_id", "score")
    return ranking.sort_rerank(s, 10)


def ann_results(spark, d) -> DataFrame:
    return ann.ann_search(store_of(spark, d), vector_queries(spark, d), k=10, ef_construction=80, ef_search=80)


QUERIES = {
    "tokenize_docs": lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.regex_tokens("text")).alias("pos", "token")),
    "whitespace_tokens": lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.whitespace_tokens("text")).alias("pos", "token")),
    "ascii_tokens": lambda s, d: docs(s, d).select("doc_id", F.explode(X.ascii_tokens("text")).alias("token")),
    "stopword_filtered": lambda s, d: index.tokens(docs(s, d), PLAIN),
    "query_terms": q_terms,
    "postings": lambda s, d: idx(s, d).postings,
    "positions": lambda s, d: r6(index.positional_index(idx(s, d).tokens)),
    "forward_index": lambda s, d: index.forward_index(idx(s, d).postings).select("doc_id", F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("terms"), F.aggregate(F.map_values("terms"), F.lit(0).cast("long"), lambda a, b: a + b).alias("dl")),
    "vocabulary": lambda s, d: index.vocabulary(idx(s, d).tokens),
    "doc_lengths": lambda s, d: idx(s, d).lengths,
    "corpus_stats": lambda s, d: r6(idx(s, d).stats),
    "doc_frequency": lambda s, d: idx(s, d).frequencies,
    "term_frequency": lambda s, d: index.term_frequency(idx(s, d).postings, docs(s, d).select("doc_id", F.explode(F.array(F.lit("index"), F.lit("query"), F.lit("zzz"))).alias("term"))),
    "bool_term": lambda s, d: matching.Term("query").evaluate(idx(s, d).postings),
    "bool_and": lambda s, d: (matching.Term("query") & matching.Term("index")).evaluate(idx(s, d).postings),
    "bool_or": lambda s, d: (matching.Term("query") | matching.Term("evidence")).evaluate(idx(s, d).postings),
    "bool_not": lambda s, d: matching.Not(matching.Term("query"), docs(s, d)).evaluate(idx(s, d).postings),
    "phrase_match": lambda s, d: matching.phrase_documents(q_terms(s, d), docs(s, d), PLAIN),
    "phrase_single": lambda s, d: matching.Phrase(["dense", "retrieval"]).evaluate(idx(s, d).tokens),
    "prefix_match": lambda s, d: matching.Prefix("omniquer").evaluate(idx(s, d).postings),
    "wildcard_match": lambda s, d: matching.Wildcard("co?a*map").evaluate(idx(s, d).postings),
    "fuzzy_single": lambda s, d: matching.Fuzzy("retriever", 2).evaluate(idx(s, d).postings),
    "fuzzy_match": lambda s, d: matching.fuzzy_matches(q_terms(s, d), idx(s, d).frequencies, 1),
    "synonym_match": lambda s, d: matching.Synonyms("query", {"query": ["evidence", "snippet"]}).evaluate(idx(s, d).postings),
    "expand_terms": lambda s, d: matching.expand_terms(q_terms(s, d), s.createDataFrame([("compare", 0, "contrast"), ("compare", 1, "versus"), ("related", 0, "linked"), ("and", 0, "plus")], "term string, ord int, related string")),
    "candidates": lambda s, d: (lambda i: matching.candidates(q_terms(s, d), i.postings, i.packed))(idx(s, d, True)),
    "bm25_topk": lambda s, d: r6(lexical.search(asked(s, d), idx(s, d, True), "OR", 10)),
    "search_and": lambda s, d: r6(lexical.search(asked(s, d), idx(s, d, True), "AND", 10)),
    "tfidf_scores": lambda s, d: r6(ranking.tfidf_scores(q_terms(s, d), idx(s, d, True))),
    "score_fusion": lambda s, d: r6(ranking.score_fusion(signals_of(s, d), s.createDataFrame([("lexical", 0.5), ("dense", 0.3), ("graph", 0.0)], "signal string, weight double"))),
    "score_rerank": lambda s, d: r6(score_sorted(s, d)),
    "rrf_fusion": lambda s, d: r6(ranking.rrf(lists_of(s, d), 10)),
    "vector_metrics": vector_metrics,
    "knn_cosine": lambda s, d: r6(dense.exact_knn(store_of(s, d), vector_queries(s, d), 10, "cosine")),
    "knn_dot": lambda s, d: r6(dense.exact_knn(store_of(s, d), vector_queries(s, d), 10, "dot")),
    "knn_euclidean": lambda s, d: r6(dense.exact_knn(store_of(s, d), vector_queries(s, d), 10, "euclidean")),
    "knn_filtered": lambda s, d: r6(dense.exact_knn(store_of(s, d), vector_queries(s, d), 5, "cosine", dense.matches_filter({"label": 1}))),
    "vector_update": updated,
    "vector_delete": lambda s, d: dense.delete_vectors(store_of(s, d), store_of(s, d).filter("ord % 3 = 0")).select("vec_id"),
    "ann_hnsw": lambda s, d: r6(ann_results(s, d)),
    "corpus_remove": lambda s, d: corpus.remove_documents(docs(s, d), table(s, d, "documents").filter("lang = 'de'")).select("doc_id"),
    "corpus_invalid": lambda s, d: corpus.invalid_documents(table(s, d, "documents")).select("doc_id"),
    "result_texts": lambda s, d: corpus.attach_text(run_of(s, d), docs(s, d)).select("query_id", "document_id", "rank", "text"),
    "graph_neighbors": lambda s, d: graph.outgoing(star_graph(s, d)[1], star_starts(s, d)).select("src", "dst"),
    "graph_degrees": lambda s, d: graph.degrees(*star_graph(s, d)),
    "graph_bfs": lambda s, d: graph.bfs(star_starts(s, d), star_graph(s, d)[1]),
    "graph_khop": lambda s, d: graph.k_hop(star_starts(s, d), star_graph(s, d)[1], 1),
    "graph_dfs": lambda s, d: graph.dfs(star_starts(s, d), star_graph(s, d)[1]),
    "graph_nodes": lambda s, d: corpus_graph(s, d)[0].select("node_id", "node_type"),
    "graph_edges": lambda s, d: corpus_graph(s, d)[1].select("src", "dst", "edge_type", "weight", "metadata"),
    "graph_match": lambda s, d: graph.match_nodes(asked(s, d), corpus_graph(s, d)[0]),
    "graph_retrieve": lambda s, d: r6(graph.graph_retrieve(asked(s, d), *corpus_graph(s, d), top_k=10)),
    "query_analysis": analysis,
    "query_classification": lambda s, d: r6(planning.classify(planning.analyze(asked(s, d))).select("query_id", "lexical_score", "dense_score", "graph_score", "primary_mode", "confidence")),
    "query_plan": lambda s, d: r6(planning.plan(asked(s, d)).select("query_id", "primary_mode", "enabled_modes", "candidate_k", "final_k", "max_graph_hops")),
    "hybrid_lexical_graph": lambda s, d: r6(hybrid_run(s, d)),
    "rerank_overlap": lambda s, d: r6(reranked(s, d)),
    "evidence": lambda s, d: r6(found_evidence(s, d).select("query_id", "document_id", "text", "score", "rank")),
    "rag_context": lambda s, d: r6(rag.context(found_evidence(s, d), 1200)),
    "eval_per_query": lambda s, d: r6(evaluation.evaluate(run_of(s, d), qrels_of(s, d), 10)),
    "eval_means": lambda s, d: r6(evaluation.means(evaluation.evaluate(run_of(s, d), qrels_of(s, d), 10))),
    "stemmed_postings": lambda s, d: index.build_index(docs(s, d)).postings,
    "toy_scan": lambda s, d: toy.scan(docs(s, d), ["Dense", "retrieval"], "and"),
    "toy_search": lambda s, d: toy.simple_search(toy.simple_index(docs(s, d)), ["Dense", "graph"], "or"),
}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_T = r"list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)), lambda x: x NOT IN (" + _STOP + "))"
BASE = f"""docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
q AS (SELECT query_id, text FROM queries WHERE trim(text) <> ''),
toks AS MATERIALIZED (SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term FROM (SELECT doc_id, {_T.format('text')} AS t FROM docs)),
qt AS (SELECT query_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ord, unnest(t) AS term FROM (SELECT query_id, {_T.format('text')} AS t FROM q)),
posts AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
lens AS (SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl FROM docs d LEFT JOIN posts p ON p.doc_id = d.doc_id GROUP BY 1),
stats AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total, sum(dl) / count(*) AS avgdl FROM lens)"""
BM25 = BASE + """,
bm AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score, count(*) AS hits
  FROM (SELECT query_id, term, count(*) AS times FROM qt GROUP BY 1, 2) JOIN dfs USING (term) JOIN posts USING (term) JOIN lens USING (doc_id), stats GROUP BY 1, 2),
top AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""
SIGNALS = """sig AS (SELECT query_id, signal, CAST(document_id AS BIGINT) AS doc_id, max(score) AS score FROM results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3)"""
EMB = "e AS (SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(vec_id AS BIGINT) AS ord, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), vq AS (SELECT ord AS query_id, v AS w FROM e WHERE ord % 20 = 0)"


def _knn(expr: str, way: str, k: int, where: str = "") -> str:
    return f"""WITH {EMB}, p AS (SELECT query_id, vec_id, ord, round({expr}, 9) AS score FROM vq, e {where}),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {way}, ord, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, vec_id, round(score, 6) + 0 AS score, rank FROM r WHERE rank <= {k}"""


STAR = """edges AS (SELECT 'nation-' || n_nationkey AS src, 'region-' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier),
starts AS (SELECT CAST(c_custkey AS BIGINT) AS query_id, 'customer-' || c_custkey AS node_id FROM customer)"""
GRAPH = """names AS (SELECT doc_id, list_filter(list_transform(coalesce(metadata.entities, []), lambda x: trim(coalesce(x, ''))), lambda x: x <> '') AS e, metadata.relations AS r FROM documents),
listed AS (SELECT DISTINCT doc_id, unnest(e) AS name FROM names),
rel0 AS (SELECT doc_id, e[1] AS first, unnest(r) AS r FROM names),
rel AS (SELECT doc_id, trim(coalesce(r.relation, '')) AS relation, CASE WHEN trim(coalesce(r.source, '')) <> '' THEN trim(r.source) ELSE coalesce(first, '') END AS src, trim(coalesce(r.target, '')) AS dst FROM rel0 WHERE r IS NOT NULL),
ok AS (SELECT * FROM rel WHERE relation <> '' AND src <> '' AND dst <> ''),
firsts AS (SELECT name, min(doc_id) AS doc_id FROM listed GROUP BY 1),
ends AS (SELECT src AS name, doc_id FROM ok UNION SELECT dst, doc_id FROM ok),
only_rel AS (SELECT name, min(doc_id) AS doc_id, count(*) AS n FROM ends WHERE name NOT IN (SELECT name FROM firsts) GROUP BY 1),
ent AS (SELECT name AS node_id, concat_ws(' ', name, 'entity name document ids source documents', CAST(doc_id AS VARCHAR)) AS words FROM firsts
  UNION ALL SELECT name, concat_ws(' ', name, 'entity name document ids documents', CAST(doc_id AS VARCHAR), CAST(n AS VARCHAR)) FROM only_rel),
entities AS (SELECT * FROM ent WHERE node_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
gedges AS (SELECT name AS src, CAST(doc_id AS VARCHAR) AS dst, 'mentioned_in' AS edge_type, CAST(to_json({'document_id': doc_id, 'source': 'metadata.entities'}) AS VARCHAR) AS metadata FROM listed
  UNION ALL SELECT src, dst, (min({'a': relation, 'b': doc_id})).a, CAST(to_json({'document_id': (min({'a': relation, 'b': doc_id})).b, 'source': src, 'target': dst}) AS VARCHAR) FROM ok GROUP BY 1, 2)"""
# a relation between a listed entity and that very document's id is left out, as the mention is there already
GRAPH = GRAPH.replace("FROM ok GROUP BY 1, 2)", "FROM ok WHERE (src, dst) NOT IN (SELECT (name, CAST(doc_id AS VARCHAR)) FROM listed) GROUP BY 1, 2)")
MATCH = GRAPH + """,
gq AS (SELECT query_id, text FROM queries WHERE trim(text) <> ''),
qtok AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM gq),
ntok AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(lower(words), '[a-z0-9]+')) AS token FROM entities),
matched AS MATERIALIZED (SELECT DISTINCT query_id, node_id FROM qtok JOIN ntok USING (token)),
ge AS MATERIALIZED (SELECT DISTINCT src, dst FROM gedges),
h1 AS MATERIALIZED (SELECT DISTINCT query_id, dst AS node_id FROM matched JOIN ge ON src = node_id),
h2 AS (SELECT DISTINCT query_id, dst AS node_id FROM h1 JOIN ge ON src = node_id),
reach AS (SELECT query_id, node_id, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM matched UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2),
gr AS (SELECT query_id, node_id AS document_id, 1.0 / (depth + 1) AS score FROM reach WHERE node_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
gtop AS (SELECT query_id, document_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM gr)"""


def _words(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


W = X.W
PLAN = f"""a0 AS (SELECT query_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized FROM queries WHERE trim(text) <> ''),
a1 AS (SELECT *, regexp_extract_all(normalized, '{W}(?:(?:{W}|-)*{W})?') AS terms,
  list_filter(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda x: trim(x)), lambda x: x <> '') AS phrases FROM a0),
a AS (SELECT query_id, text, normalized, terms, phrases, CAST(len(terms) AS INTEGER) AS term_count, len(phrases) > 0 AS has_exact_phrase,
  contains(text, '?') OR list_has_any(terms, {_words(planning.QUESTION)}) AS has_question_form,
  list_has_any(terms, {_words(planning.COMPARISON)}) AS has_comparison_signal,
  list_has_any(terms, {_words(planning.RELATIONSHIP)}) AS has_relationship_signal,
  regexp_matches(text, '{planning.IDENTIFIER}') AS has_identifier_signal,
  list_has_any(terms, {_words(planning.EXPLANATORY)}) AS has_explanatory_signal FROM a1),
c AS (SELECT *, 3.0 * has_exact_phrase::INT + 4 * has_identifier_signal::INT + (term_count <= 2)::INT AS l,
  2.0 * has_comparison_signal::INT + 2 * has_explanatory_signal::INT + has_question_form::INT + (term_count >= 6)::INT AS dn,
  4.0 * has_relationship_signal::INT + 2 * has_comparison_signal::INT AS g FROM a),
cl AS (SELECT *, greatest(l, dn, g) AS best, (l = greatest(l, dn, g))::INT + (dn = greatest(l, dn, g))::INT + (g = greatest(l, dn, g))::INT AS winners FROM c),
cls AS (SELECT *, CASE WHEN best = 0 OR winners > 1 THEN 'hybrid' WHEN l = best THEN 'lexical' WHEN dn = best THEN 'dense' ELSE 'graph' END AS primary_mode,
  CASE WHEN best = 0 THEN 0.0 WHEN winners > 1 THEN least(best / (l + dn + g), 0.5) ELSE best / (l + dn + g) END AS confidence,
  CASE WHEN best < 1 THEN 'lexical,dense,graph' WHEN dn >= 1 AND l < 1 AND g < 1 AND has_explanatory_signal THEN 'lexical,dense'
    ELSE concat_ws(',', CASE WHEN l >= 1 THEN 'lexical' END, CASE WHEN dn >= 1 THEN 'dense' END, CASE WHEN g >= 1 THEN 'graph' END) END AS modes FROM cl)"""
EVID = BM25 + """,
ev AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, text, round(score, 6) AS score, rank FROM top JOIN docs USING (doc_id) WHERE rank <= 5)"""
EVAL = """run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM (SELECT query_id, document_id, max(score) AS score FROM results WHERE signal = 'lexical' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)),
rels AS (SELECT query_id, document_id, count(DISTINCT signal) - 1 AS rel FROM results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
nrel AS (SELECT query_id, count(*) FILTER (rel > 0) AS n FROM rels GROUP BY 1),
j AS (SELECT r.query_id, r.rank, coalesce(x.rel, 0) AS rel, CAST(coalesce(x.rel, 0) > 0 AS INT) AS hit, power(2, coalesce(x.rel, 0)) - 1 AS gain FROM run r LEFT JOIN rels x USING (query_id, document_id)),
k AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS ideal,
  row_number() OVER (PARTITION BY query_id, rank <= 10 ORDER BY gain DESC) AS ideal_k FROM j),
m AS (SELECT query_id, count(*) AS rows, sum(hit) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS fh, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS ap,
  sum(gain / log2(rank + 1)) AS dcg, sum(gain / log2(ideal + 1)) AS idcg, count(*) FILTER (rank <= 10) AS rows_k, coalesce(sum(hit) FILTER (rank <= 10), 0) AS hits_k,
  coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg_k, coalesce(sum(gain / log2(ideal_k + 1)) FILTER (rank <= 10), 0) AS idcg_k FROM k GROUP BY 1),
ev AS (SELECT query_id, coalesce(hits / nullif(rows, 0), 0) AS precision, coalesce(hits / nullif(n, 0), 0) AS recall, coalesce(CASE WHEN n > 0 THEN 1.0 / fh END, 0) AS reciprocal_rank,
  coalesce(ap / nullif(n, 0), 0) AS average_precision, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg, coalesce(hits_k / nullif(rows_k, 0), 0) AS precision_at_k,
  coalesce(hits_k / nullif(n, 0), 0) AS recall_at_k, coalesce(dcg_k / nullif(idcg_k, 0), 0) AS ndcg_at_k FROM nrel FULL JOIN m USING (query_id))"""

SQL = {
    "tokenize_docs": r"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL)",
    "whitespace_tokens": r"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[^\s\pZ\x{1c}-\x{1f}\x{85}]+') AS t FROM documents WHERE text IS NOT NULL)",
    "ascii_tokens": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE text IS NOT NULL",
    "stopword_filtered": f"WITH {BASE} SELECT doc_id, pos, term FROM toks",
    "query_terms": f"WITH {BASE} SELECT query_id, ord, term FROM qt",
    "postings": f"WITH {BASE} SELECT term, doc_id, tf FROM posts",
    "positions": f"WITH {BASE} SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM toks GROUP BY 1, 2",
    "forward_index": f"WITH {BASE} SELECT doc_id, string_agg(term || ':' || tf, ',' ORDER BY term) AS terms, CAST(sum(tf) AS BIGINT) AS dl FROM posts GROUP BY 1",
    "vocabulary": f"WITH {BASE}, f AS (SELECT term, min({{'a': doc_id, 'b': pos}}) AS f FROM toks GROUP BY 1) SELECT term, row_number() OVER (ORDER BY f.a, f.b) - 1 AS term_id FROM f",
    "doc_lengths": f"WITH {BASE} SELECT doc_id, dl FROM lens",
    "corpus_stats": f"WITH {BASE} SELECT n, total, round(avgdl, 6) AS avgdl FROM stats",
    "doc_frequency": f"WITH {BASE} SELECT term, df FROM dfs",
    "term_frequency": f"WITH {BASE} SELECT d.doc_id, w.term, coalesce(tf, 0) AS tf FROM docs d, (VALUES ('index'), ('query'), ('zzz')) w(term) LEFT JOIN posts p ON p.doc_id = d.doc_id AND p.term = w.term",
    "bool_term": f"WITH {BASE} SELECT DISTINCT doc_id FROM posts WHERE term = 'query'",
    "bool_and": f"WITH {BASE} SELECT doc_id FROM posts WHERE term = 'query' INTERSECT SELECT doc_id FROM posts WHERE term = 'index'",
    "bool_or": f"WITH {BASE} SELECT doc_id FROM posts WHERE term = 'query' UNION SELECT doc_id FROM posts WHERE term = 'evidence'",
    "bool_not": f"WITH {BASE} SELECT doc_id FROM docs EXCEPT SELECT doc_id FROM posts WHERE term = 'query'",
    "phrase_match": f"WITH {BASE}, p AS (SELECT * FROM qt), n AS (SELECT query_id, count(*) AS n FROM p GROUP BY 1) SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id, t.pos - p.ord AS s, count(*) AS h FROM p JOIN toks t USING (term) GROUP BY 1, 2, 3) JOIN n USING (query_id) WHERE h = n",
    "phrase_single": f"WITH {BASE} SELECT DISTINCT a.doc_id FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'dense' AND b.term = 'retrieval'",
    "prefix_match": f"WITH {BASE} SELECT DISTINCT doc_id FROM posts WHERE starts_with(term, 'omniquer')",
    "wildcard_match": f"WITH {BASE} SELECT DISTINCT doc_id FROM posts WHERE regexp_full_match(term, 'co.a.*map')",
    "fuzzy_single": f"WITH {BASE} SELECT DISTINCT doc_id FROM posts WHERE levenshtein(term, 'retriever') <= 2",
    "fuzzy_match": f"WITH {BASE}, t AS (SELECT DISTINCT query_id, term FROM qt) SELECT query_id, t.term, d.term AS \"match\" FROM t JOIN dfs d ON abs(length(d.term) - length(t.term)) <= 1 AND levenshtein(d.term, t.term) <= 1",
    "synonym_match": f"WITH {BASE} SELECT DISTINCT doc_id FROM posts WHERE term IN ('query', 'evidence', 'snippet')",
    "expand_terms": f"""WITH {BASE}, x(term, b, related) AS (VALUES ('compare', 0, 'contrast'), ('compare', 1, 'versus'), ('related', 0, 'linked'), ('and', 0, 'plus')),
        u AS (SELECT query_id, ord AS a, -1 AS b, term FROM qt UNION ALL SELECT query_id, ord, b, related FROM qt JOIN x USING (term)),
        f AS (SELECT query_id, term, min({{'a': a, 'b': b}}) AS k FROM u GROUP BY 1, 2) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k.a, k.b, term) - 1 AS INTEGER) AS ord, term FROM f""",
    "candidates": f"WITH {BASE} SELECT DISTINCT query_id, doc_id FROM qt JOIN posts USING (term)",
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10",
    "search_and": f"WITH {BM25}, need AS (SELECT query_id, count(DISTINCT term) AS need FROM qt GROUP BY 1), f AS (SELECT bm.* FROM bm JOIN need USING (query_id) WHERE hits = need), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "tfidf_scores": f"WITH {BASE} SELECT query_id, doc_id, term, tf, round(ln((n + 1.0) / (df + 1.0)) + 1, 6) AS idf, round(tf * (ln((n + 1.0) / (df + 1.0)) + 1), 6) AS tfidf FROM (SELECT DISTINCT query_id, term FROM qt) JOIN dfs USING (term) JOIN posts USING (term), stats",
    "score_fusion": f"""WITH {SIGNALS}, x AS (SELECT query_id, signal, min(score) AS lo, max(score) AS hi FROM sig GROUP BY 1, 2), w(signal, weight) AS (VALUES ('lexical', 0.5::DOUBLE), ('dense', 0.3::DOUBLE))
        SELECT query_id, doc_id, round(round(sum(weight * CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END), 9), 6) AS score FROM sig JOIN x USING (query_id, signal) JOIN w USING (signal) GROUP BY 1, 2""",
    "score_rerank": f"WITH {SIGNALS}, r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sig WHERE signal = 'graph') SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "rrf_fusion": f"""WITH {SIGNALS}, l AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rk FROM sig),
        f AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score FROM l GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM f)
        SELECT query_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "vector_metrics": f"WITH {EMB}, p AS (SELECT query_id, w, list_transform(v, lambda x: x * 3.0::DOUBLE) AS s FROM vq JOIN e ON e.ord = query_id + 1) SELECT query_id, round(list_inner_product(w, s), 6) AS dot, round(list_cosine_similarity(w, s), 6) AS cosine, round(list_distance(w, s), 6) AS euclidean, round(sqrt(list_inner_product(s, s)), 6) AS norm, 0.0::DOUBLE AS zero FROM p",
    "knn_cosine": _knn("list_cosine_similarity(w, v)", "DESC", 10),
    "knn_dot": _knn("list_inner_product(w, v)", "DESC", 10),
    "knn_euclidean": _knn("list_distance(w, v)", "ASC", 10),
    "knn_filtered": _knn("list_cosine_similarity(w, v)", "DESC", 5, "WHERE label = 1"),
    "vector_update": "SELECT CAST(vec_id AS VARCHAR) AS vec_id, CASE WHEN vec_id % 50 = 0 THEN '-1' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings",
    "vector_delete": "SELECT CAST(vec_id AS VARCHAR) AS vec_id FROM embeddings WHERE vec_id % 3 <> 0",
    "corpus_remove": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> 'de'",
    "corpus_invalid": "SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id < 0 OR text IS NULL",
    "result_texts": f"WITH {EVAL} SELECT query_id, document_id, CAST(rank AS INTEGER) AS rank, text FROM run LEFT JOIN (SELECT * FROM documents WHERE text IS NOT NULL) ON CAST(doc_id AS VARCHAR) = document_id",
    "graph_neighbors": f"WITH {STAR} SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM starts)",
    "graph_degrees": f"""WITH {STAR}, nodes AS (SELECT 'region-' || r_regionkey AS node_id FROM region UNION ALL SELECT 'nation-' || n_nationkey FROM nation UNION ALL SELECT 'customer-' || c_custkey FROM customer UNION ALL SELECT 'supplier-' || s_suppkey FROM supplier),
        o AS (SELECT src, count(*) AS c FROM edges GROUP BY 1), i AS (SELECT dst, count(*) AS c FROM edges GROUP BY 1) SELECT node_id, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM nodes LEFT JOIN o ON src = node_id LEFT JOIN i ON dst = node_id""",
    "graph_bfs": f"WITH RECURSIVE {STAR}, b AS (SELECT query_id, node_id, 0 AS depth FROM starts UNION SELECT query_id, dst, depth + 1 FROM b JOIN edges ON src = node_id) SELECT query_id, node_id, min(depth) AS depth FROM b GROUP BY 1, 2",
    # every node of this graph leads to at most one other, so depth first is straight ahead
    "graph_dfs": f"WITH RECURSIVE {STAR}, b AS (SELECT query_id, node_id, 0 AS depth FROM starts UNION ALL SELECT query_id, dst, depth + 1 FROM b JOIN edges ON src = node_id) SELECT query_id, depth AS step, node_id, depth FROM b",
    "graph_khop": f"WITH {STAR} SELECT DISTINCT query_id, dst AS node_id, 1 AS depth FROM starts JOIN edges ON src = node_id",
    "graph_nodes": f"WITH {GRAPH} SELECT CAST(doc_id AS VARCHAR) AS node_id, 'document' AS node_type FROM documents UNION ALL SELECT node_id, 'entity' FROM entities",
    "graph_edges": f"WITH {GRAPH} SELECT src, dst, edge_type, 1.0::DOUBLE AS weight, metadata FROM gedges",
    "graph_match": f"WITH {MATCH} SELECT query_id, node_id FROM matched",
    "graph_retrieve": f"WITH {MATCH} SELECT query_id, document_id, round(score, 6) AS score, rank FROM gtop WHERE rank <= 10",
    "query_analysis": f"WITH {PLAN} SELECT query_id, normalized, array_to_string(terms, ',') AS terms, array_to_string(phrases, ',') AS phrases, term_count, has_exact_phrase, has_question_form, has_comparison_signal, has_relationship_signal, has_identifier_signal, has_explanatory_signal FROM a",
    "query_classification": f"WITH {PLAN} SELECT query_id, CAST(l AS DOUBLE) AS lexical_score, CAST(dn AS DOUBLE) AS dense_score, CAST(g AS DOUBLE) AS graph_score, primary_mode, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM cls",
    "query_plan": f"WITH {PLAN} SELECT query_id, primary_mode, modes AS enabled_modes, 50 AS candidate_k, 10 AS final_k, CASE WHEN contains(modes, 'graph') THEN 2 ELSE 0 END AS max_graph_hops FROM cls",
    "hybrid_lexical_graph": "WITH " + BM25 + ", " + MATCH + ", " + PLAN + """,
        lists AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, rank FROM top JOIN cls USING (query_id) WHERE rank <= 50 AND contains(modes, 'lexical')
          UNION ALL SELECT query_id, document_id, rank FROM gtop JOIN cls USING (query_id) WHERE rank <= 50 AND contains(modes, 'graph')),
        f AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM lists GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM f) SELECT query_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "rerank_overlap": f"""WITH {BM25}, w AS (SELECT query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM q),
        s AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(list_sum(list_transform(ws, lambda x: (length(lower(text)) - length(replace(lower(text), x, ''))) / length(x))) AS DOUBLE) AS score FROM top JOIN docs USING (doc_id) JOIN w USING (query_id) WHERE rank <= 10),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM s) SELECT query_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "evidence": f"WITH {EVID} SELECT query_id, document_id, text, score, rank FROM ev",
    "rag_context": f"""WITH {EVID}, s AS (SELECT *, '[SOURCE ' || rank || E']\\ndocument_id: ' || document_id || E'\\nretrieval_score: ' || printf('%.6f', score) || E'\\ntext:\\n' || text AS section FROM ev),
        h AS (SELECT *, sum(length(section) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS held FROM s)
        SELECT query_id, string_agg(section, E'\\n\\n' ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS sources, string_agg(document_id, ',' ORDER BY rank) AS document_ids FROM h WHERE held <= 1200 GROUP BY 1""",
    "eval_per_query": f"WITH {EVAL} SELECT query_id, " + ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in evaluation.METRICS) + " FROM ev",
    "eval_means": f"WITH {EVAL} SELECT " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in evaluation.METRICS) + ", count(*) AS queries FROM ev",
    "toy_scan": r"SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(text, '[^\s\pZ\x{1c}-\x{1f}\x{85}]+'), ['Dense', 'retrieval'])",
    "toy_search": r"SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['dense', 'graph'])",
}
