"""Queries scored in blocks of documents: the same rows as joins give, without pairs of query and document that move."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkir.functions.text import Analyzer
from sparkir.operators import blocks, dense, graph, index, lexical, matching, ranking

PLAIN = Analyzer(stem=False)


@pytest.fixture(scope="module")
def corpus(spark):
    """Few words of very unlike frequency, so that scores tie; a blank text, a null one, and queries with unknown and repeated words."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    often = [1 / (i + 1) for i in range(40)]
    texts = [(i * 7 + 1, " ".join(r.choices(words, often, k=r.choice([2, 3, 5, 30])))) for i in range(600)] + [(5, "..."), (12, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(i, " ".join(r.choices([*words, "nowhere"], k=r.choice([1, 2, 3, 6])))) for i in range(60)] + [(100, "w0"), (101, "w0 w1"), (102, "w39 w0 w0")]
    return docs, spark.createDataFrame(asked, "query_id long, text string")


def joined(docs, queries, mode, k):
    """What a join of terms and postings gives."""
    plain = index.build_index(docs, PLAIN)
    return lexical.search(queries, plain, mode, k)


@pytest.mark.parametrize("mode", ["OR", "AND"])
@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize("most", [300, 10**6])
def test_best_of_blocks_are_the_best(spark, rows, corpus, monkeypatch, mode, k, most):
    docs, queries = corpus
    monkeypatch.setattr(blocks, "HELD", most)
    found = lexical.search(queries, index.build_index(docs, PLAIN, True), mode, k)
    r9 = lambda df: rows(df.withColumn("score", F.round("score", 8)))
    assert r9(found) == r9(joined(docs, queries, mode, k))


def test_search_joins_no_postings(spark, corpus):
    docs, queries = corpus
    found = lexical.search(queries, index.build_index(docs, PLAIN, True), "OR", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # that of the rank, of the best of each block


def test_queries_go_in_groups(spark, rows, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(blocks.grouped, "__defaults__", (40,))
    i = index.build_index(docs, PLAIN, True)
    assert len(list(blocks.grouped(matching.query_terms(queries, PLAIN)))) > 3
    assert rows(lexical.search(queries, i, "OR", 5).select("query_id", "doc_id", "rank")) == rows(joined(docs, queries, "OR", 5).select("query_id", "doc_id", "rank"))


def test_graph_search_goes_by_token(spark, rows, monkeypatch):
    """Many queries of the same words are one search each; answers are those of a search for every query."""
    r = random.Random(5)
    ends = [f"d{i}" for i in range(60)] + [f"word{i % 6} name{i}" for i in range(40)]
    nodes = spark.createDataFrame([(n, "document" if n[0] == "d" else "entity", "{}") for n in ends], "node_id string, node_type string, metadata string")
    edges = spark.createDataFrame([(r.choice(ends[60:]), r.choice(ends[:60] if r.random() < 0.3 else ends), i) for i in range(150)], "src string, dst string, ord long")
    edges = edges.filter("src <> dst")
    queries = spark.createDataFrame([(i, r.choice(["word1", "word2 name3", "word3 word4 unknown", "name7"])) for i in range(80)], "query_id long, text string")
    reach = graph.bfs(graph.match_nodes(queries, nodes), edges, 2).join(nodes.filter("node_type = 'document'").select("node_id"), "node_id", "left_semi")
    kept = []
    for name in ("stage", "cut"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, *a, real=real: (lambda out: (kept.append(out.count()), out)[1])(real(df, *a)))
    for k in (2, 5, 100):
        found = graph.graph_retrieve(queries, nodes, edges, k, 2)
        score = reach.select("query_id", F.col("node_id").alias("document_id"), (F.lit(1.0) / (F.col("depth") + 1)).alias("score"))
        assert rows(found.select("query_id", "document_id", "score", "rank")) == rows(ranking.ranked(score, k, "document_id").select("query_id", "document_id", "score", "rank"))
        assert sum(kept) < 1500  # edges, and nodes by the six tokens; 80 queries reach more than that each hop
        kept.clear()


def test_postings_are_not_broadcast(spark, rows, corpus):
    """Spark expects exploded texts to be small; term frequencies do not rely on that."""
    docs, _ = corpus
    wanted = docs.select("doc_id", F.explode(F.array(F.lit("w0"), F.lit("w1ish"))).alias("term"))
    got = index.term_frequency(index.build_index(docs, PLAIN).postings, wanted, F.regexp_replace("term", "ish$", ""))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    assert rows(got.select("doc_id", "term", "tf")) == sorted(((d, t, texts[d].count(t.removesuffix("ish"))) for d in texts for t in ("w0", "w1ish")), key=repr)


def test_phrases_in_blocks(spark, rows, corpus, monkeypatch):
    """Repeated words, gaps between documents, unknown words; nothing is joined or moved."""
    docs, queries = corpus
    monkeypatch.setattr(blocks, "HELD", 500)
    more = spark.createDataFrame([(200, "w0 w0"), (201, "w0 w1 w0"), (202, "w1 nowhere"), (203, "w2")], "query_id long, text string")
    phrases = matching.query_terms(queries.unionByName(more), PLAIN)
    found = matching.phrase_documents(phrases, docs, PLAIN)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want = rows(matching.phrase_matches(phrases, index.build_index(docs, PLAIN).tokens))
    assert rows(found) == want and len({q for q, _ in want} & {200, 201, 203}) == 3


def test_candidates_of_packed_postings(spark, rows, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(blocks, "HELD", 500)
    terms, plain, kept = matching.query_terms(queries, PLAIN), index.build_index(docs, PLAIN), index.build_index(docs, PLAIN, True)
    found = matching.candidates(terms, kept.postings, kept.packed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert rows(found) == rows(matching.candidates(terms, plain.postings))


def test_tfidf_of_packed_postings(spark, rows, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(blocks, "HELD", 500)
    terms, round9 = matching.query_terms(queries, PLAIN), [F.round(c, 9) for c in ("idf", "tfidf")]
    found = ranking.tfidf_scores(terms, index.build_index(docs, PLAIN, True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want = ranking.tfidf_scores(terms, index.build_index(docs, PLAIN))
    assert rows(found.select("query_id", "doc_id", "term", "tf", *round9)) == rows(want.select("query_id", "doc_id", "term", "tf", *round9))


def test_many_short_query_vectors_are_sent_whole(spark, rows):
    """What is sent is bounded by values, not by queries: vectors do not meet 8,193 short queries in copies."""
    r = np.random.default_rng(4)
    x, q = r.integers(1, 4, (40, 3)).astype(float), r.integers(1, 4, (8193, 3)).astype(float)
    store = spark.createDataFrame([(f"v{i}", i, e.tolist()) for i, e in enumerate(x)], "vec_id string, ord long, embedding array<double>")
    queries = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(q)], "query_id long, embedding array<double>")
    found = dense.exact_knn(store, queries, 3)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    c = np.round(q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :], 9)
    want = [(i, f"v{j}") for i in range(len(q)) for j in np.lexsort((np.arange(40), -c[i]))[:3]]
    assert rows(found.select("query_id", "vec_id")) == sorted(want, key=repr)


def test_whole_lists_join_no_postings(spark, rows, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(blocks, "HELD", 300)
    terms = matching.query_terms(queries, PLAIN)
    found = lexical.BM25Retriever(index.build_index(docs, PLAIN, True)).retrieve(terms)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = lexical.BM25Retriever(index.build_index(docs, PLAIN)).retrieve(terms)
    assert rows(found.withColumn("score", F.round("score", 8))) == rows(want.withColumn("score", F.round("score", 8)))


def test_saved_index_is_packed_and_answers_alike(spark, rows, corpus, tmp_path):
    docs, queries = corpus
    kept = index.build_index(docs, PLAIN, True)
    kept.write(str(tmp_path))
    back = index.Index.read(spark, str(tmp_path), PLAIN)
    assert blocks.can_pack(back.packed) and not (tmp_path / "postings").exists()
    assert rows(back.postings.select("term", "doc_id", "tf")) == rows(index.build_index(docs, PLAIN).postings)
    assert rows(lexical.search(queries, back, "OR", 5)) == rows(lexical.search(queries, kept, "OR", 5))
