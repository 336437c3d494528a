import math
from datetime import datetime as D

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkir.llm import distinctive, terms

POST = "term string, doc_id long, tf int, indexed_at timestamp_ntz, documents long, background double"


def posts(spark, rows):
    return spark.createDataFrame([(*r, 99, 9.9) for r in rows], POST)


def test_rows_that_count(spark, rows):
    t = lambda d: D(2024, 1, d)
    p = posts(spark, [("a", 1, 5, t(1)), (" A ", 1, 2, t(2)), ("a", 1, 2, t(2)), ("a", 1, 9, None), (None, 1, 1, t(1)), ("", 1, 1, t(1)), ("b", None, 1, t(1)), ("c", 2, None, None), ("d", 2, 3, t(3)), ("d", 2, 4, t(3))])
    assert rows(terms.counted_postings(p)) == [("a", 1, 2), ("c", 2, 0), ("d", 2, 4)]
    assert terms.counted_postings(p.limit(0)).count() == 0


def test_text_postings_read_whole_texts(spark, rows):
    d = spark.createDataFrame([(1, "A a_b É2!", "x"), (2, None, "x"), (3, " ", "x"), (4, "w " * 50_000, "x")], "doc_id long, text string, term string")
    assert rows(terms.text_postings(d)) == [("a", 1, 2), ("b", 1, 1), ("w", 4, 50_000), ("é2", 1, 1)]


def test_frequencies_and_marks(spark, rows):
    p = spark.createDataFrame([("a", i, 2) for i in range(3)] + [("b", 1, 1), ("c", 1, 1), ("c", 2, 1)], "term string, doc_id long, tf long")
    assert rows(terms.term_frequency(p, 10)) == [("a", 6, 3, "common"), ("b", 1, 1, "rare"), ("c", 2, 2, None)]
    assert rows(terms.term_frequency(p, 1).select("term", "mark")) == [("a", "common"), ("b", "rare"), ("c", "common")]
    assert terms.term_frequency(p.limit(0), 0).count() == 0


def test_models(spark, rows):
    p = spark.createDataFrame([(w, i, 2) for i in range(20) for w in ("the", "index")] + [("gate", 0, 4), ("gate", 1, 1), ("zero", 2, 0)] + [("none", 99, 0)], "term string, doc_id long, tf long")
    m = {(r.doc_id, r.term): r for r in distinctive.term_models(p).collect()}
    assert len(m) == 44  # every row is scored
    assert m[0, "gate"].rank == 1 and m[0, "gate"].probability > 0.9 and m[0, "gate"].documents == 2
    assert m[2, "zero"].probability == 0 and m[99, "none"].probability == 0
    assert rows(distinctive.found_terms(p)) == [(0, "gate")]
    assert distinctive.term_models(p.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(1e-4, 0.2)), min_size=1, max_size=12))
def test_em_reaches_its_fixed_point(items):
    tf, bg = np.array([float(a) for a, _ in items]), np.array([b for _, b in items])
    p = distinctive.parsimonious(tf, bg, np.array([0]), 0.1, 1e-13, 100_000)
    assert math.isclose(p.sum(), 1, abs_tol=1e-6)
    own = 0.1 * p
    e = tf * own / np.maximum(own + 0.9 * bg, 1e-300)
    assert np.allclose(e / e.sum(), p, atol=1e-5)


def test_a_document_does_not_depend_on_its_batch():
    r = np.random.default_rng(0)
    tf, bg = r.integers(1, 9, 60).astype(float), r.uniform(1e-4, 0.1, 60)
    starts = np.array([0, 7, 8, 30])
    whole = distinctive.parsimonious(tf, bg, starts, 0.1, 1e-6, 200)
    for a, b in zip(starts, [7, 8, 30, 60]):
        assert np.array_equal(distinctive.parsimonious(tf[a:b], bg[a:b], np.array([0]), 0.1, 1e-6, 200), whole[a:b])


def test_shuffled_postings_give_the_same(spark, rows):
    p = spark.createDataFrame([(f"t{(i * j) % 7}", i, j + 1) for i in range(10) for j in range(4)], "term string, doc_id long, tf long").groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    cols = ("doc_id", "term", "rank")
    assert rows(distinctive.term_models(p), *cols) == rows(distinctive.term_models(p.repartition(7)), *cols)


def test_found_terms_come_from_the_models(spark, rows, monkeypatch):
    r = np.random.default_rng(4)
    data = [(f"t{t}", d, int(r.integers(1, 9))) for d in range(60) for t in {*r.integers(0, 40, 25), 100 + d // 3, 200 + d // 5}]
    p = spark.createDataFrame(data, "term string, doc_id long, tf long")
    total, df = {}, {}
    for t, d, n in data:
        total[d], df[t] = total.get(d, 0) + n, df.get(t, 0) + 1
    want = sorted(((d, t) for t, d, n in data if n >= 3 and n * 25 >= total[d] and 2 <= df[t] <= 8), key=repr)
    assert want and rows(distinctive.found_terms(p)) == want == rows(distinctive.found_terms(p.repartition("doc_id"), together=True))
    monkeypatch.setattr(distinctive, "MOST_TERMS", 5)
    monkeypatch.setattr(distinctive, "AT_ONCE", 50)
    assert rows(distinctive.found_terms(p)) == want
    monkeypatch.setattr(distinctive, "parsimonious", lambda tf, *_: np.zeros(len(tf)))
    assert rows(distinctive.found_terms(p)) == []


def test_postings_of_a_document_together(spark, rows):
    p = spark.createDataFrame([(" A ", 1, 2, None), ("a", 1, 3, None), ("b", 2, 1, None), (None, 2, 1, None), ("b", None, 1, None)], "term string, doc_id long, tf int, indexed_at timestamp_ntz")
    for most in (1, 100):
        assert rows(terms.counted_postings(p, together=True, most=most)) == rows(terms.counted_postings(p)) == [("a", 1, 3), ("b", 2, 1)]
