import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkir.llm import nearest as N

SCHEMA = "vec_id string, ord long, embedding array<double>, id long, cosine double"


def frame(spark, rows):
    return spark.createDataFrame([(n, o, v, 1, 0.0) for n, o, v in rows], SCHEMA)


def clustered(n=600, dim=24, seed=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + r.normal(size=dim) * 0.15
    return x * r.uniform(0.1, 10, (n, 1))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_usable_vectors(spark, rows):
    v = frame(spark, [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 2, [0.0, 1.0]), ("b", 1, [0.0, 0.0]), ("c", 1, [1.0]), ("d", 1, None), ("e", 1, [1.0, None]), ("f", 1, [float("nan"), 1.0]), (None, 1, [1.0, 1.0]), ("g", None, [2.0, 0.0]), ("h", 1, [1.0, 1.0]), ("h", 2, None)])
    assert rows(N.usable_vectors(v)) == [("a", [0.0, 1.0]), ("g", [2.0, 0.0])]
    assert N.usable_vectors(v.limit(0)).count() == 0


def test_close_pairs_equal_brute_force(spark, rows):
    x = clustered()
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    want = set()
    for i in range(len(x)):
        for j in np.argsort(-c[i])[:5]:
            if c[i, j] >= 0.95:
                want.add(tuple(sorted((f"v{i}", f"v{j}"))))
    v = N.usable_vectors(frame(spark, [(f"v{i}", 0, e.tolist()) for i, e in enumerate(x)]))
    got = set(rows(N.close_pairs(N.nearest(v, least=0.95))))
    assert len(want) > 100 and got == want


def test_crowded_buckets_lose_nothing(spark, rows):
    r = np.random.default_rng(2)
    x = np.concatenate([np.ones((150, 24)) + r.normal(size=(150, 24)) * 0.02, clustered(200)])
    v = N.usable_vectors(frame(spark, [(f"v{i}", 0, e.tolist()) for i, e in enumerate(x)]))
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    want = {(f"v{i}", f"v{j}") for i in range(350) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.95}
    assert {r[:2] for r in rows(N.nearest(v, least=0.95, crowded=20))} == want
    asked = spark.createDataFrame([(f"v{i}",) for i in range(0, 350, 10)], "vec_id string")
    got = {r[:2] for r in rows(N.nearest(v, least=0.95, crowded=20, radius=1, queries=asked))}
    assert got == {w for w in want if int(w[0][1:]) % 10 == 0}


def test_exact_neighbours_of_blocks_and_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "CELLS", 6)
    x = clustered(300)
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    e = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(x)], "id long, embedding array<double>, asked boolean")
    for least in (None, 0.9):
        best = {}
        for r in N.exact_neighbours(e, 4, least).collect():
            best.setdefault(r.id, {})[r.id_b] = r.cosine
        for i in range(0, 300, 3):
            want = {int(j) for j in np.argsort(-c[i])[:4] if least is None or c[i, j] >= least}
            assert set(sorted(best.get(i, {}), key=lambda j: -best[i][j])[:4]) == want
    assert N.exact_neighbours(e.limit(0), 4, None).count() == 0


def test_plans_follow_the_centred_angle():
    r = np.random.default_rng(3)
    x = unit(np.ones((2000, 24)) * 0.6 + r.normal(size=(2000, 24)) * 0.2)
    q = N.Quantiser(x)
    assert N.chance_to_differ(x, q.mean, q.matrix(64), 0.95) > 1.3 * np.arccos(0.95) / np.pi


def test_copies_and_ties(spark):
    v = N.usable_vectors(frame(spark, [(f"c{i:03d}", 0, [1.0, 2.0, 3.0, 4.0]) for i in range(50)] + [("x", 0, [1.0, 2.0, 3.0, 4.1]), ("y", 0, [-1.0, 0.0, 0.0, 0.0])]))
    got = {}
    for r in N.nearest(v, k=5, least=0.95).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour))
    assert [n for _, n in sorted(got["c000"])] == ["c001", "c002", "c003", "c004", "c005"]
    assert [n for _, n in sorted(got["c049"])] == ["c000", "c001", "c002", "c003", "c004"]
    assert [n for _, n in sorted(got["x"])] == ["c000", "c001", "c002", "c003", "c004"] and "y" not in got


def test_recall_of_a_query_set(spark):
    x = clustered(1500, 24, 9)
    v = N.usable_vectors(frame(spark, [(str(i), 0, e.tolist()) for i, e in enumerate(x)]))
    asked = spark.createDataFrame([(str(i),) for i in range(0, 1500, 20)], "vec_id string")
    got = N.nearest(v, k=5, cosine=None, recall=0.9, radius=1, spread=0.5, per_bucket=16, words=3, queries=asked).collect()
    c = unit(x) @ unit(x).T
    np.fill_diagonal(c, -2)
    hits = [len({r.neighbour for r in got if r.vec_id == str(i)} & {str(j) for j in np.argsort(-c[i])[:5]}) / 5 for i in range(0, 1500, 20)]
    assert np.mean(hits) >= 0.9
    r = got[0]
    assert r.cosine == pytest.approx(c[int(r.vec_id), int(r.neighbour)])


def test_no_vectors(spark):
    assert N.nearest(N.usable_vectors(frame(spark, []))).count() == 0
    assert N.nearest(N.usable_vectors(frame(spark, [("a", 1, [1.0, 2.0])]))).count() == 0


def test_plans_reach_their_recall():
    for rows in (100, 100_000, 10**9, 10**12):
        p = N.substrings_for(rows, 0.1, 0.999, 1, 4.5)
        assert 8 <= p.bits <= 41 and p.substrings >= 2
    assert p.bits == 40


def test_passes_find_what_one_finds_and_leave_no_index(spark, rows, monkeypatch):
    """Substrings are sorted a few at a time; the index is gone and only what was found is kept when the next are."""
    r = np.random.default_rng(8)
    base = r.normal(size=(150, 16))
    x = np.concatenate([base, base + 0.05 * r.normal(size=base.shape)])
    v = N.usable_vectors(frame(spark, [(str(i), i, e.tolist()) for i, e in enumerate(x)])).cache()
    want = rows(N.close_pairs(N.nearest(v, least=0.95)))
    sizes, real = [], N.stage
    monkeypatch.setattr(N, "stage", lambda df, name="stage": (sizes.append((name, df.count())), real(df, name))[1])
    monkeypatch.setattr(N, "PASS", 1)
    monkeypatch.setattr(N, "PASS_EACH", 1)
    assert rows(N.close_pairs(N.nearest(v, least=0.95))) == want and len(want) >= 140
    found = [n for name, n in sizes if name == "met"]
    assert len(found) > 3 and max(found) <= 600  # pairs of few bits apart, not entries of the index


def test_keys_are_the_bits_of_substrings(spark):
    r = np.random.default_rng(9)
    x, matrix = r.normal(size=(20, 8)), r.normal(size=(8, 8 * 30))
    plan = N.Plan(11, 20, 0, 64)
    entries = frame(spark, [(str(i), i, e.tolist()) for i, e in enumerate(x)]).select(F.col("ord").alias("id"), "embedding")
    got = N._codes(entries, plan, np.zeros(8), matrix).select("id", *[N._key(plan, j).alias(f"k{j}") for j in range(20)]).orderBy("id").collect()
    bits = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix > 0
    want = [[int((bits[i, j * 11 : j * 11 + 11] << np.arange(11)).sum()) * 20 + j for j in range(20)] for i in range(20)]
    assert [list(g)[1:] for g in got] == want
