import random
from datetime import datetime as D
from math import comb, log

import pytest
from pyspark.sql import functions as F

from sparkir.llm import rankfuse as R

RES = "query_id long, signal string, document_id string, score double, metadata string, retrieved_at timestamp_ntz, place long, rank int"
QUE = "query_id long, lexical_score double, dense_score double, graph_score double, lists int"


def res(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], RES)


def que(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], QUE)


def test_rows_that_count(spark, rows):
    t = lambda d: D(2024, 1, d)
    r = res(spark, [
        (1, "lexical", "a", 5.0, None, t(1)), (1, "lexical", "a", 1.0, None, t(2)), (1, "lexical", "a", 1.0, None, t(2)), (1, "lexical", "a", None, None, t(3)), (1, "lexical", "a", float("nan"), None, t(4)),
        (1, "dense", "a", 2.0, '{"metric":"euclidean"}', None), (1, "dense", "b", 2.0, '{"note":"not euclidean"}', t(1)), (1, "graph", "b", 0.0, "{", t(1)),
        (None, "graph", "b", 0.0, None, t(1)), (1, "other", "b", 0.0, None, t(1)), (1, "graph", None, 0.0, None, t(1))])
    assert rows(R.counting_results(r)) == [(1, "dense", "a", -2.0), (1, "dense", "b", 2.0), (1, "graph", "b", 0.0), (1, "lexical", "a", 1.0)]


def test_counting_signals(spark, rows):
    q = que(spark, [(1, 1.0, 0.0, None), (2, 0.0, None, float("nan")), (3, 0.0, 2.0, 1.0), (3, 1.0, None, None), (None, 1.0, 1.0, 1.0)])
    assert rows(R.counting_signals(q)) == [(1, True, False, False), (2, True, True, True), (3, True, True, True)]


def rho(r):
    n, r = len(r), sorted(r)
    return min(1.0, n * min(sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)) for k, x in enumerate(r, 1)))


def test_significance_equals_the_formula(spark):
    g = random.Random(3)
    data = [[g.choice([g.random(), 1.0, 0.5]) for _ in range(n)] + [None] * (4 - n) for n in (1, 2, 3, 4) for _ in range(15)]
    for width in (3, 4):
        part = [d[:width] for d in data if all(x is None for x in d[width:])]
        df = spark.createDataFrame(part, ", ".join(f"c{i} double" for i in range(width)))
        got = [x[0] for x in df.select(R.significance([F.col(c) for c in df.columns])).collect()]
        assert got == pytest.approx([rho([x for x in d if x is not None]) for d in part])


def brute(results, signals):
    lists = {}
    for q, s, d, v in results:
        lists.setdefault((q, s), []).append((d, v))
    out = {}
    for q in {q for q, *_ in results}:
        on = signals.get(q, list(R.SIGNALS))
        for d in {d for qq, s, d, _ in results if qq == q and s in on}:
            places, normal = {}, []
            for s in on:
                mine = lists.get((q, s), [])
                v = dict(mine).get(d)
                if v is not None:
                    places[s] = 1 + sum(w > v for _, w in mine)
                    normal.append(places[s] / len(mine))
                else:
                    normal.append(1.0)
            out[q, d] = (len(on), places, rho(normal))
    return out


def test_fusion_equals_brute_force_with_and_without_hot_queries(spark):
    g = random.Random(5)
    seen, data = set(), []
    for _ in range(900):
        key = (g.choice([7, 7, 7, 1, 2, 3]), g.choice(R.SIGNALS), str(g.randrange(120)))
        if key not in seen:
            seen.add(key)
            data.append((*key, float(g.randrange(30)) * {"lexical": 1, "dense": 0.01, "graph": 1000}[key[1]]))
    q = [(7, 1.0, 0.0, 2.0), (1, None, None, None), (2, 0.0, 3.0, 0.0)]
    want = brute(data, {7: ["lexical", "graph"], 2: ["dense"]})
    for least in (100_000, 40):
        got = R.fuse(res(spark, [(*r, None, D(2024, 1, 1)) for r in data]), que(spark, q), least=least).collect()
        assert {(r.query_id, r.document_id) for r in got} == set(want)
        for r in got:
            n, places, s = want[r.query_id, r.document_id]
            assert r.lists == n and {s: r[f"place_{s}"] for s in R.SIGNALS if r[f"place_{s}"] is not None} == places and r.significance == pytest.approx(s, abs=1e-9)
            assert r["rank"] == 1 + sum(round(-log(v[2]), 9) > round(-log(s), 9) for (qq, _), v in want.items() if qq == r.query_id)
        near = {(r.query_id, r.document_id) for r in R.agreed(spark.createDataFrame(got)).collect()}
        assert near == {k for k, (n, p, _) in want.items() if n >= 2 and len(p) == n and max(p.values()) <= 5}


def test_the_best_of_long_lists_are_told_apart(spark):
    data = [(1, s, str(d), float(-d), None, D(2024, 1, 1)) for s in R.SIGNALS for d in range(20_000)]
    top = R.fuse(res(spark, data), que(spark, [])).filter("rank <= 4").orderBy("rank").collect()
    assert [(r.document_id, r["rank"]) for r in top] == [("0", 1), ("1", 2), ("2", 3), ("3", 4)]


def test_scale_does_not_matter(spark, rows):
    base = [(1, s, str(d), float((d * 7) % 11), None, D(2024, 1, 1)) for s in R.SIGNALS for d in range(11)]
    big = [(q, s, d, v * 1e6 + 3 if s == "graph" else v, m, t) for q, s, d, v, m, t in base]
    q = que(spark, [])
    assert rows(R.fuse(res(spark, base), q)) == rows(R.fuse(res(spark, big), q))
    assert R.fuse(res(spark, []), q).count() == 0
