import random

import numpy as np
from pyspark.sql import functions as F

from sparkir.llm import neardup as D

SCHEMA = "doc_id long, text string, class_id long, key string, id string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=4, base=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(base):
        words = ["the", "a", "of"] + r.sample(vocab, 36)
        texts.append(" ".join(words))
        for _ in range(r.randrange(3)):
            w = list(words)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            cut = r.randrange(len(w))
            texts.append(" ".join(w[cut:] + w[:cut]))  # sentences change places
    r.shuffle(texts)
    return list(enumerate(texts, 1)) + [(1000, None), (1001, ""), (1002, "too few words"), (1003, texts[0].upper()), (1004, texts[0] + "\n"), (None, texts[1])]


def brute(rows, least=30, similarity=0.8):
    bags = {i: set(t.lower().split()) for i, t in rows if t and i is not None}
    bags = {i: b for i, b in bags.items() if len(b) >= least}
    return sorted(((i, j) for i in bags for j in bags if i < j and len(bags[i] & bags[j]) >= similarity * len(bags[i] | bags[j]) - 1e-9), key=repr)


def test_pairs_equal_brute_force(spark, rows):
    data = corpus()
    want = brute(data)
    assert len(want) > 10
    assert rows(D.document_pairs(*D.near_duplicates(make(spark, data), least_words=30))) == want
    # crowded buckets are paired by their rarest words, and lose nothing either
    assert rows(D.document_pairs(*D.near_duplicates(make(spark, data), least_words=30, bucket=1))) == want


def test_groups(spark):
    data = corpus()
    pairs = brute(data)
    parent = {i: i for i, t in data if t and i is not None and len(set(t.lower().split())) >= 30}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    every = D.duplicate_groups(*D.near_duplicates(make(spark, data), least_words=30), make(spark, data)).collect()
    assert sorted(r.doc_id for r in every) == sorted(i for i, _ in data if i is not None)
    assert {(r.doc_id, r.group_id, r.links) for r in every if r.doc_id in (1000, 1001, 1002)} == {(i, i, 0) for i in (1000, 1001, 1002)}
    got = [r for r in every if r.doc_id in parent]
    assert {r.doc_id: r.group_id for r in got} == {i: root(i) for i in parent}
    assert all(r.links == 0 for r in got if r.group_id == r.doc_id and sum(x.group_id == r.group_id for x in got) == 1)


def test_exact_copies_are_one_class(spark):
    data = [(i, "alpha beta gamma delta " * 20) for i in range(200)] + [(500, "epsilon zeta")]
    members, pairs = D.near_duplicates(make(spark, data))
    assert pairs.count() == 0 and members.agg(F.count_distinct("class_id")).first()[0] == 2
    assert D.document_pairs(members, pairs).count() == 200 * 199 // 2


def test_empty_and_long_texts(spark):
    members, pairs = D.near_duplicates(make(spark, []))
    assert members.count() == 0 and pairs.count() == 0 and D.duplicate_groups(members, pairs).count() == 0
    r = random.Random(1)
    long = [f"v{r.randrange(4000)}" for _ in range(20_000)]
    got = D.near_duplicates(make(spark, [(1, " ".join(long)), (2, " ".join(long[200:] + ["x"] * 5)), (3, None)]))[1].collect()
    assert [(r.class_a, r.class_b) for r in got] == [(1, 2)] and got[0].similarity > 0.95


def test_repeated_ids_count_once(spark, rows):
    members, _ = D.near_duplicates(make(spark, [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "a b c d e f")]))
    assert rows(members.select("doc_id")) == [(1,), (2,)]


def test_band_alignment_is_exact_on_sorted_sets():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 60, 30))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.85], r.integers(0, 60, 4)]))
        d = max(len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a)))
        assert D.matches_in_band([a], [b], np.array([d]))[0] == len(np.intersect1d(a, b))
    def lcs(x, y):
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]
    for _ in range(50):
        x, y = r.integers(0, 5, 12), r.integers(0, 5, 15)
        assert D.matches_in_band([x], [y], np.array([20]))[0] == lcs(x, y)


def test_pairs_aligned_together_do_not_disturb_each_other():
    r = np.random.default_rng(4)
    a = [np.unique(r.integers(0, 90, r.integers(1, 60))) for _ in range(300)]
    b = [np.unique(r.integers(0, 90, r.integers(1, 60))) for _ in range(300)]
    got = D.matches_in_band(a, b, np.full(300, 90))
    assert got.tolist() == [len(np.intersect1d(x, y)) for x, y in zip(a, b)]
    assert len(D.matches_in_band([], [], np.array([]))) == 0


def test_sketches_keep_order():
    words = D.mix(np.arange(40, dtype=np.uint64))
    both = np.concatenate([words, words[::-1]])
    k = D.order_sketches(both, np.array([0, 40]), np.ones(80), 64, 2)
    assert (k[0] == k[1]).sum() == 0  # the same words in reverse
    for weight in (None, np.ones(80)):
        same = D.order_sketches(np.concatenate([words, words]), np.array([0, 40]), weight, 64, 2)
        assert (same[0] == same[1]).all()
    few = D.order_sketches(words[:3], np.array([0, 1]), None, 8, 3)  # fewer items than are kept
    assert few.shape == (2, 8) and (few[0] != few[1]).all()


def test_k_mers_stay_inside_their_text():
    word = np.array([1, 2, 3, 9, 1, 2, 3, 4], np.int64)
    h, at = D.k_mers(word, np.array([0, 3, 4]), 2)
    assert at.tolist() == [0, 2, 3] and len(h) == 6 and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert D.k_mers(word, np.array([0, 3, 4]), 1)[0].tolist() == word.tolist()


def test_meetings_are_streamed(spark):
    import pyarrow as pa

    r = random.Random(2)
    data = sorted((r.choice([5] * 9 + [1, 2, 3, 7, 8, 9, 10]), i, 40, 0) for i in range(200))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], pa.int64()) for c in range(4)], names=["key", "id", "n", "p0"])
    by_key = {}
    for k, i, *_ in data:
        by_key.setdefault(k, []).append(i)
    for bucket in (1, 20, 1000):
        want = {(a, b) for v in by_key.values() if len(v) <= bucket for a in v for b in v if a < b} | {(i, -1) for v in by_key.values() if len(v) > bucket for i in v}
        for step in (1, 7, 50, 200):
            got = [(int(a), int(b)) for x, y in D.meetings((batch(data[lo : lo + step]) for lo in range(0, 200, step)), bucket, 0.8) for a, b in zip(x, y)]
            assert len(got) == len(set(got)) and set(got) == want


def test_parity_words_differ_by_at_most_the_differing_words(spark):
    import pyarrow as pa

    r = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 62, 60, dtype=np.int64))
        b = np.unique(np.concatenate([a[3:], r.integers(0, 1 << 62, 3, dtype=np.int64)]))
        p = [D.parities(x.view(np.uint64), np.array([len(x)]))[0, 0] for x in (a, b)]
        row = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([1, 1], [1, 2], [len(a), len(b)], p)], names=["key", "id", "n", "p0"])
        assert [(x.tolist(), y.tolist()) for x, y in D.meetings(iter([row]), 10, 0.8) if len(x)] == [([1], [2])]


def test_keys_known_to_be_crowded_lose_nothing(spark, rows, monkeypatch):
    data = corpus()
    monkeypatch.setattr(D, "LOOK_AHEAD", 10)
    monkeypatch.setattr(D, "SEEN", 0)
    assert rows(D.document_pairs(*D.near_duplicates(make(spark, data), least_words=30, bucket=1))) == brute(data)


def test_groups_hold_short_texts_too(spark, tmp_path):
    from sparkir.llm import queries as Q

    r = random.Random(6)
    vocab, data = [f"w{i}" for i in range(40)], []
    for i in range(300):  # everyday words, of which one is left out of the copy or replaced by a word of its own
        words = r.sample(vocab, 4 + i % 24)
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, f"only{i}"]))]
    make(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in Q.p7_groups(spark, str(tmp_path)).collect()}
    want = brute(data, least=1)
    bags = {i: frozenset(t.split()) for i, t in data}
    classes = {}
    for i in sorted(bags):
        classes.setdefault(bags[i], i)
    links = {c: {classes[bags[b if a == c else a]] for a, b in want if c in (a, b)} - {c} for c in classes.values()}
    assert len(want) >= 300 and {i: got[i].links for i in bags} == {i: len(links[classes[bags[i]]]) for i in bags}


def test_a_text_and_its_repetition_are_a_pair(spark, rows):
    r = random.Random(8)
    data, want = [], []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}x{i}" for _ in range(100)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words * 10, *[f"new{k}x{i}" for k in range(5)]]))]
        want.append((2 * i, 2 * i + 1))
    assert rows(D.document_pairs(*D.near_duplicates(make(spark, data), least_words=30))) == sorted(want, key=repr)


def test_every_parity_word_rules_pairs_out():
    import pyarrow as pa

    for size in (2, 60):  # side by side, and in tiles
        row = lambda p1: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([7] * size, list(range(size)), [40] * size, [5] * size, p1)], names=["key", "id", "n", "p0", "p1"])
        pairs = lambda p1: sum(len(x) for x, _ in D.meetings(iter([row(p1)]), 100, 0.8))
        assert pairs([9] * size) == size * (size - 1) // 2
        assert pairs([0] + [2**20 - 1] * (size - 1)) == (size - 1) * (size - 2) // 2  # 20 words apart, of 8 allowed


def test_large_keys_meet_as_small_ones_do():
    import pyarrow as pa

    r = np.random.default_rng(11)
    m = 2300
    n = r.integers(30, 60, m)
    p = r.integers(0, 1 << 62, (4, 12), dtype=np.int64)[:, r.integers(0, 12, m)] ^ (1 << r.integers(0, 60, (4, m)))
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (np.full(m, 3), np.arange(m), n, *p)], names=["key", "id", "n", "p0", "p1", "p2", "p3"])
    got = [(int(a), int(b)) for x, y in D.meetings((batch(slice(i, i + 700)) for i in range(0, m, 700)), m, 0.8) for a, b in zip(x, y)]
    apart = sum(np.bitwise_count((w[:, None] ^ w[None, :]).view(np.uint64)).astype(int) for w in p)
    ok = (np.minimum.outer(n, n) >= 0.8 * np.maximum.outer(n, n) - 1e-9) & (apart <= np.add.outer(n, n) / 9 + 1e-9)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(ok, 1)))))
    assert len(want) > 10_000 and len(got) == len(set(got)) and set(got) == want


def test_keys_that_grow_with_the_table_are_met_directly(spark, rows, monkeypatch):
    data = []
    for i in range(150):
        words = [f"w{k}x{i}" for k in range(40)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, f"only{i}"]))]
    monkeypatch.setattr(D, "_by_rare_words", None)  # 300 classes: keys of up to three are no crowd
    assert rows(D.document_pairs(*D.near_duplicates(make(spark, data), least_words=30, bucket=1))) == brute(data)


def test_pairs_are_verified_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    members = spark.createDataFrame([(i, i, True) for i in range(1, 5)], "doc_id long, class_id long, paired boolean")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "class_a long, class_b long").mapInArrow(counted, "class_a long, class_b long")
    assert sorted(map(tuple, D.document_pairs(members, pairs).collect())) == [(1, 2), (2, 3)]
    assert seen.value == 2


def test_texts_are_taken_apart_once(spark, rows):
    w = D.texts_as_words(make(spark, [(1, "a b a"), (2, "--"), (3, None), (4, " "), (None, "a")]))
    assert w._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert rows(w, "doc_id", "n") == [(1, 2)]
