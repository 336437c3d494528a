import math

import pytest
from pyspark.sql import functions as F

from sparkir.functions.text import Analyzer
from sparkir.operators import index as I
from sparkir.operators import matching as M
from sparkir.operators import ranking as R
from sparkir.operators import toy
from sparkir.operators.lexical import BM25Retriever, search
from sparkir.sources import corpus as C

SMALL = [(1, "machine learning systems"), (2, "machine learning"), (3, "cats and dogs"), (4, ""), (5, None)]


def docs(spark, data=SMALL):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in data], "doc_id long, text string, term string, pos string")


def qs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def test_index_tables(spark, rows):
    i = I.build_index(docs(spark, [(1, "a1 b b c"), (2, "c c the b"), (3, None), (4, " ")]), Analyzer(stem=False))
    assert rows(i.postings) == [("a1", 1, 1), ("b", 1, 2), ("b", 2, 1), ("c", 1, 1), ("c", 2, 2)]
    assert rows(I.positional_index(i.tokens)) == [("a1", 1, [0]), ("b", 1, [1, 2]), ("b", 2, [2]), ("c", 1, [3]), ("c", 2, [0, 1])]
    assert rows(i.lengths) == [(1, 4), (2, 3), (3, 0), (4, 0)]
    assert rows(i.stats) == [(4, 7, 1.75)]
    assert rows(i.frequencies) == [("a1", 1), ("b", 2), ("c", 2)]
    assert rows(I.vocabulary(i.tokens)) == [("a1", 0), ("b", 1), ("c", 2)]
    assert {r.doc_id: r.terms for r in I.forward_index(i.postings).collect()} == {1: {"a1": 1, "b": 2, "c": 1}, 2: {"c": 2, "b": 1}}
    wanted = spark.createDataFrame([(1, "b"), (1, "cs"), (2, "zz")], "doc_id long, term string")
    assert rows(I.term_frequency(i.postings, wanted, F.substring("term", 1, 1)), "doc_id", "term", "tf") == [(1, "b", 2), (1, "cs", 1), (2, "zz", 0)]
    assert rows(I.document_frequency(i.frequencies, wanted.select("term"), F.substring("term", 1, 1)), "term", "df") == [("b", 2), ("cs", 2), ("zz", 0)]
    empty = I.build_index(docs(spark, []), Analyzer(stem=False))
    assert rows(empty.stats) == [(0, 0, 0.0)] and empty.postings.count() == 0 and I.vocabulary(empty.tokens).count() == 0


def test_index_round_trip(spark, rows, tmp_path):
    i = I.build_index(docs(spark), Analyzer(stem=False))
    i.write(str(tmp_path), 2)
    back = I.Index.read(spark, str(tmp_path), i.analyzer)
    q = qs(spark, "machine learning")
    assert rows(search(q, back)) == rows(search(q, i))


def test_boolean_queries(spark, rows):
    p = I.build_index(docs(spark, [(1, "machine learning systems"), (2, "machine vision")]), Analyzer()).postings
    universe = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    m, ln = M.Term("machin"), M.Term("learn")
    assert rows(m.evaluate(p)) == [(1,), (2,)] and rows((m & ln).evaluate(p)) == [(1,)]
    assert rows((ln | M.Term("vision")).evaluate(p)) == [(1,), (2,)]
    assert rows(M.Not(m, universe).evaluate(p)) == [(3,)]
    assert rows(M.And(m, M.Not(ln, universe)).evaluate(p)) == [(2,)]
    for bad, error in ((lambda: M.Term(" "), ValueError), (lambda: M.Term(3), TypeError), (lambda: M.And(m, "x"), TypeError), (lambda: M.Phrase([]), ValueError), (lambda: M.Fuzzy("a", -1), ValueError)):
        with pytest.raises(error):
            bad()


def test_phrases(spark, rows):
    t = I.build_index(docs(spark, [(1, "dense the dense retrieval"), (2, "retrieval dense"), (3, None)]), Analyzer(stem=False)).tokens
    assert rows(M.Phrase(["dense", "retrieval"]).evaluate(t)) == [(1,)]
    assert rows(M.Phrase(["dense", "dense"]).evaluate(t)) == [(1,)]  # stop words leave no gap
    assert rows(M.Phrase(["dense"]).evaluate(t)) == [(1,), (2,)]
    many = spark.createDataFrame([(1, 0, "dense"), (1, 1, "retrieval"), (2, 0, "retrieval"), (2, 1, "dense"), (3, 0, "zz")], "query_id long, ord int, term string")
    assert rows(M.phrase_matches(many, t)) == [(1, 1), (2, 2)]


def test_vocabulary_queries(spark, rows):
    p = spark.createDataFrame([("retrieve", 1, 1), ("retriever", 2, 1), ("retrieving", 3, 1), ("a.b", 4, 1), ("axb", 5, 1), (None, 6, 1)], "term string, doc_id long, tf long")
    ids = lambda q: [r[0] for r in rows(q.evaluate(p))]
    assert ids(M.Prefix("retrieve")) == [1, 2] and ids(M.Wildcard("*ing")) == [3] and ids(M.Wildcard("a.b")) == [4] and ids(M.Wildcard("a?b")) == [4, 5]
    assert ids(M.Fuzzy("retrievr", 1)) == [1, 2] and ids(M.Fuzzy("retrieve", 0)) == [1]
    assert ids(M.Synonyms("axb", {"axb": ["a.b", "axb"]})) == [4, 5]
    t = spark.createDataFrame([(1, "retrievr"), (2, "ab"), (2, "ab"), (3, "r")], "query_id long, term string")
    for d in (0, 1, 2):
        want = sorted({(q, a, b) for q, a in [(1, "retrievr"), (2, "ab"), (3, "r")] for b in ["retrieve", "retriever", "retrieving", "a.b", "axb"] if _edits(a, b) <= d})
        assert rows(M.fuzzy_matches(t, p.select("term"), d)) == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_expansion(spark, rows):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x")], "query_id long, ord int, term string")
    e = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("c", 0, "z")], "term string, ord int, related string")
    assert rows(M.expand_terms(t, e)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")]


def test_bm25(spark, rows):
    i = I.build_index(docs(spark, SMALL[:3]))
    got = search(qs(spark, "machine learning", "zzz", "the", "machine machine"), i).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got if r.query_id == 1] == [2, 1] and {r.query_id for r in got} == {1, 4}
    idf, avg = math.log(1 + 1.5 / 2.5), 7 / 3
    one = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))
    assert [r.score for r in got if r.doc_id == 2] == pytest.approx([2 * one, 2 * one], abs=1e-8)
    both = I.build_index(docs(spark, [(1, "machine learning"), (2, "machine vision"), (3, "cats and dogs")]))
    assert rows(search(qs(spark, "machine learning"), both, "and").select("doc_id")) == [(1,)]
    terms = M.query_terms(qs(spark, "machine"), both.analyzer)
    assert rows(BM25Retriever(both).retrieve(terms).select("doc_id", "rank")) == [(1, 1), (2, 2)]  # a tie goes by id
    for bad in (dict(mode="xor"), dict(top_k=0)):
        with pytest.raises(ValueError):
            search(qs(spark, "x"), both, **bad)
    with pytest.raises(TypeError):
        BM25Retriever(both, k1=1)
    with pytest.raises(ValueError):
        M.check_queries(qs(spark, " "))
    assert search(qs(spark, "machine"), I.build_index(docs(spark, []))).count() == 0


def test_tfidf(spark, rows):
    i = I.build_index(docs(spark, [(1, "a1 a1 b"), (2, "b")]), Analyzer(stem=False))
    got = {r.doc_id: r.tfidf for r in R.tfidf_scores(M.query_terms(qs(spark, "a1 b"), i.analyzer), i).filter("term = 'b'").collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0})
    assert R.tfidf_scores(M.query_terms(qs(spark, "a1"), i.analyzer), i).first().tfidf == pytest.approx(2 * (math.log(3 / 2) + 1))


def test_fusion_and_sorting(spark, rows):
    s = spark.createDataFrame([(1, "lexical", 1, 0.2), (1, "lexical", 2, 0.8), (1, "x", 3, 5.0), (1, "same", 4, 1.0), (1, "same", 5, 1.0)], "query_id long, signal string, doc_id long, score double")
    w = spark.createDataFrame([("lexical", 1.0), ("same", 2.0), ("none", 1.0)], "signal string, weight double")
    assert rows(R.score_fusion(s, w), "doc_id", "score") == [(1, 0.0), (2, 1.0), (4, 0.0), (5, 0.0)]
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.9)], "query_id long, doc_id long, score double")
    assert [tuple(r) for r in R.sort_rerank(scores, 2).select("doc_id", "score").orderBy("rank").collect()] == [(3, 0.9), (1, 0.5)]
    assert R.sort_rerank(scores, 0).count() == 0 and R.sort_rerank(scores).count() == 3
    with pytest.raises(ValueError):
        R.score_fusion(s, spark.createDataFrame([("a", -1.0)], "signal string, weight double"))


def test_rrf(spark, rows):
    lists = spark.createDataFrame([(1, "a", "10", 1), (1, "a", "10", 2), (1, "a", "2", 3), (1, "b", "2", 1), (1, "b", "7", 2)], "query_id long, list string, document_id string, rank int")
    got = R.rrf(lists, 3).orderBy("rank").collect()
    assert [r.document_id for r in got] == ["2", "10", "7"]
    assert got[0].score == pytest.approx(1 / 63 + 1 / 61) and got[1].score == pytest.approx(1 / 61)
    tie = spark.createDataFrame([(1, "a", "10", 1), (1, "b", "2", 1)], "query_id long, list string, document_id string, rank int")
    assert [r.document_id for r in R.rrf(tie).orderBy("rank").collect()] == ["10", "2"]  # as strings


def test_cross_rerank(spark):
    d = docs(spark, [(1, "machine learning guide"), (2, "machine learning machine"), (3, " ")])
    q = qs(spark, "machine")
    c = spark.createDataFrame([(1, "1", 9.0, 1), (1, "2", 8.0, 2), (1, "1", 7.0, 3)], "query_id long, document_id string, score double, rank int")
    assert [(r.document_id, r.score) for r in R.cross_rerank(c, q, d, R.occurrences).orderBy("rank").collect()] == [("2", 2.0), ("1", 1.0)]
    blank = spark.createDataFrame([(1, "3", 9.0, 1)], c.schema)
    with pytest.raises(Exception, match="no text"):
        R.cross_rerank(blank, q, d, R.occurrences).collect()


def test_corpus(spark, rows, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('[{"document_id": 1, "text": "a", "metadata": {"topic": "t", "entities": ["E"], "relations": [{"relation": "r", "target": "x"}]}}, {"document_id": 2, "text": ""}]')
    c = C.load_corpus(spark, str(p))
    assert rows(c.select("doc_id", "text", "metadata.entities")) == [(1, "a", ["E"]), (2, "", None)]
    for bad in ('[{"document_id": 1, "text": "a"}, {"document_id": 1, "text": "b"}]', '[{"document_id": -1, "text": "a"}]', '[{"text": "a"}]', '[{"document_id": "x", "text": "a"}]', "[{"):
        p.write_text(bad)
        spark.catalog.clearCache()
        with pytest.raises(ValueError):
            C.load_corpus(spark, str(p))
    p.write_text('[{"document_id": 1, "text": "a"}, {"document_id": 2}, {"document_id": 3}]')
    with pytest.raises(ValueError, match="record: 2"):
        C.load_corpus(spark, str(p))
    p.write_text('{"document_id": 1, "text": "a"}\n\n{"document_id": 2, "text": "b", "other": 1}\n')
    assert rows(C.load_corpus(spark, str(p)), "doc_id") == rows(C.load_lines(spark, str(p)), "doc_id") == [(1,), (2,)]
    p.write_text('{"document_id": 1, "text": "a"}\n{"document_id":')
    with pytest.raises(ValueError, match='record: {"document_id":$'):
        C.load_lines(spark, str(p))
    p.write_text("[]")
    assert C.load_corpus(spark, str(p)).count() == 0
    d = docs(spark)
    assert rows(C.invalid_documents(d), "doc_id") == [(5,)]
    assert rows(C.remove_documents(d, spark.createDataFrame([(1,), (9,)], "doc_id long")), "doc_id") == [(2,), (3,), (4,), (5,)]
    with pytest.raises(KeyError):
        C.get_document(d, 99)
    with pytest.raises(ValueError):
        C.add_documents(d, d.filter("doc_id = 1"))
    assert rows(C.attach_text(spark.createDataFrame([("1",), ("77",)], "document_id string"), d)) == [("1", "machine learning systems"), ("77", None)]


def test_toys(spark, rows):
    d = docs(spark, [(1, "A b"), (2, "b c b"), (3, None)])
    assert rows(toy.scan(d, ["A", "b"], "and")) == [(1,)] and rows(toy.scan(d, ["A", "c"], "or")) == [(1,), (2,)] and rows(toy.scan(d, ["a"], "not")) == [(1,), (2,), (3,)]
    i = toy.simple_index(d)
    assert rows(i.filter("term = 'b'")) == [("b", [1, 2], [[1], [0, 2]])]
    assert rows(toy.simple_search(i, ["A", "b"])) == [(1,)]
