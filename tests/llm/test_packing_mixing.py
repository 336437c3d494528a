import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkir.llm import mixing as X
from sparkir.llm import packing as P
from sparkir.llm import tokens as T

WIN = "window_name string, capacity_tokens int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.lists(st.integers(1, 64), min_size=1, max_size=4))
def test_bins_hold_every_item_once(sizes, caps):
    caps = [*caps, 64]
    bins = P.pack(sizes, caps)
    assert sorted(i for _, b in bins for i in b) == list(range(len(sizes)))
    for cap, b in bins:
        held = sum(sizes[i] for i in b)
        assert cap in caps and held <= cap and not any(held <= c < cap for c in caps)


def test_packing_is_tight():
    r = random.Random(2)
    sizes = [min(4096, int(r.lognormvariate(4.5, 1)) + 1) for _ in range(5000)]
    bins = P.pack(sizes, [256, 512, 2048, 4096])
    assert sum(sizes) / sum(c for c, _ in bins) > 0.998
    with pytest.raises(ValueError):
        P.pack([5], [4])


def test_pack_texts(spark):
    w = spark.createDataFrame([("small", 10), ("also", 10), ("large", 40), (None, 99), ("bad", -1), ("null", None)], WIN)
    r = random.Random(3)
    data = [(i, r.randrange(1, 30)) for i in range(300)] + [(900, 95), (901, 0), (902, None), (None, 5), (903, 40)] + [(1, None)]
    d = spark.createDataFrame([(i, n, "x", 7) for i, n in data], "doc_id long, tokens long, bin_id string, piece int")
    d = d.unionByName(d.filter("doc_id = 900"))
    for shard in (20_000, 50):
        got = P.pack_texts(d, w, shard_items=shard).collect()
        whole = {i: n for i, n in data if i is not None and n}
        held = {}
        for x in got:
            held.setdefault(x.doc_id, []).append((x.start_token, x.tokens))
        assert set(held) == set(whole)
        for i, parts in held.items():
            parts.sort()
            assert sum(n for _, n in parts) == whole[i] and [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert len(parts) == 1 or whole[i] > 40
        fills = {}
        for x in got:
            fills.setdefault((x.bin_id, x.capacity, x.window_name), []).append(x.tokens)
        assert all(sum(v) <= k[1] and k[2] in ("also", "large") for k, v in fills.items()) and len({k[0] for k in fills}) == len(fills)
    assert P.fill_report(P.pack_texts(d, w)).agg(F.sum("tokens")).first()[0] == sum(whole.values())
    assert P.pack_texts(d.limit(0), w).count() == 0
    with pytest.raises(ValueError):
        P.pack_texts(d, w.filter("capacity_tokens < 0"))


def test_tokens(spark):
    d = spark.createDataFrame([(1, "Dense retrieval <|endoftext|>"), (2, ""), (3, None), (4, "word " * 30_000)], "i int, text string")
    n = [r.n for r in d.select("i", T.token_counter()("text").alias("n")).orderBy("i").collect()]
    assert n[0] > 3 and n[1:3] == [0, 0] and n[3] >= 30_000


SIZED = "doc_id long, source string, tokens long"
TARGET = "source string, target_share double, max_repeats int"


def test_rates_and_shares(spark):
    r = random.Random(4)
    data = [(i, "big" if i % 3 else "mid", r.randrange(50, 150)) for i in range(3000)] + [(5000 + i, "tiny", 100) for i in range(20)] + [(6000, "off", 100), (6001, None, 100), (6002, "big", 0), (6003, "big", None)]
    sized = spark.createDataFrame(data, SIZED)
    targets = spark.createDataFrame([(" BIG", 0.3, 4), ("mid", 0.6, 4), ("tiny", 0.05, 2), ("gone", 0.05, 1), ("off", 0.0, 3), (None, 0.5, 1)], TARGET)
    rates = X.repetition_rates(sized, targets, tolerance=0.0)
    by = {x[0]: x for x in rates}
    assert by["gone"][5] == 0 and by["off"][5] == 0 and all(x[5] <= x[2] for x in rates)
    m = X.mixture(sized, rates)
    rep = {x.source: x for x in X.share_report(m, rates).collect()}
    for s, want in (("big", 0.3), ("mid", 0.6), ("tiny", 0.05)):
        assert rep[s].reached_share == pytest.approx(want / 0.95, abs=0.03), s
    assert m.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    copies = {x.doc_id: x.n for x in m.groupBy("doc_id").agg(F.max("copy").alias("n")).collect()}
    lim = {x[0]: (x[2], x[5]) for x in rates}
    for i, s, n in data:
        if copies.get(i):
            assert copies[i] <= lim[s][0] and copies[i] in (int(lim[s][1]), int(lim[s][1]) + 1)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, X.mixture(sized.repartition(7), rates).collect()))
    bigger = X.repetition_rates(sized, targets, total=10.0**9)
    assert {x[0]: x[5] for x in bigger}["mid"] == 4.0


def test_empty_mixtures(spark):
    sized, targets = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 2)], TARGET)
    rates = X.repetition_rates(sized, targets)
    assert X.mixture(sized, rates).count() == 0
    rep = X.share_report(X.mixture(sized, rates), rates).first()
    assert (rep.reached_share, rep.mixed_tokens) == (0.0, 0)
    none = X.repetition_rates(sized, targets.limit(0))
    assert none == [] and X.mixture(sized, none).count() == 0


def test_draws_keep_the_proportion_of_sizes(spark):
    data = [(i, "s", 10 + i % 5) for i in range(200)] + [(1000 + i, "s", 5000 + i) for i in range(40)]
    sized = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    rates = [("s", 1.0, 3, 240, sum(t for *_, t in data), 1.25)]
    want = None
    for least in (1_000_000, 30):
        got = X.mixture(sized, rates, least=least).collect()
        twice = [r.doc_id for r in got if r.copy == 2]
        assert len(got) == 240 + len(twice) and sum(i < 1000 for i in twice) == 50 and sum(i >= 1000 for i in twice) == 10
        assert want is None or sorted(twice) == want
        want = sorted(twice)
    chance = [len({r.doc_id for r in X.mixture(sized, rates, seed=k).collect() if r.copy == 2} & {0, 1000}) for k in range(8)]
    assert 0 < sum(chance) < 16  # other seeds draw others
    rep = X.share_report(X.mixture(sized, rates), rates).first()
    assert rep.expected_share == 1.0 and rep.reached_share == 1.0
