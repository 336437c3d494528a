"""Most similar vectors for every vector (problem 6): multi-index hashing over learned rotated binary codes.

Vectors become bits: the signs of their coordinates after rotations that bring the coordinates of a sample close to +-1
(iterative quantisation). The bits are split into substrings, each with an index of its own. Two codes that differ in at
most (radius + 1) x substrings - 1 bits agree in some substring up to ``radius`` bits, so probing every substring within
``radius`` retrieves them all; farther codes are retrieved with the chance that `substrings_for` states. What is
retrieved is reranked by the floats. Vectors of crowded buckets are compared with each other exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, comb, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.operators.skew import salted_join
from sparkir.session import stage, unstage

#: Bits that candidates are held against each other by, in words of 64.
WORD = 64
#: A bucket of more entries is crowded.
CROWDED = 1000
#: Vectors of a block of the exact comparison, and at most so many cells that blocks are made of.
BLOCK = 4096
CELLS = 256
#: Entries of the index that are sorted at a time: so many, or so many per vector. What they take of the disk is freed between.
PASS = 2_500_000
PASS_EACH = 2
#: At most so many numbers, and a fifth as many names, are broadcast: some megabytes.
FEW = 1_000_000


@dataclass(frozen=True)
class Plan:
    """bits per substring, their number, the radius each is probed with, and the most differing bits that are kept."""

    bits: int
    substrings: int
    radius: int
    most_apart: int


def substrings_for(rows: int, differs: float, recall: float, radius: int, spread: float, per_bucket: float = 1, words: int = 2) -> Plan:
    """The plan for an index of ``rows`` vectors that retrieves pairs with ``recall`` whose bits differ with chance ``differs``.

    Substrings are about as long as it takes to leave ``per_bucket`` rows in a bucket, however many rows there are. One
    substring of b bits is within ``radius`` with a binomial chance, and enough of them give the recall. Candidates with
    more differing bits than expected, plus ``spread`` standard deviations, are dropped.
    """
    bits = max(8, round(log2(max(rows / per_bucket, 2))))
    one = sum(comb(bits, i) * differs**i * (1 - differs) ** (bits - i) for i in range(radius + 1))
    n = WORD * words
    most = n * differs + spread * sqrt(n * differs * (1 - differs))
    return Plan(bits, max(2, ceil(log(1 - recall) / log(1 - one))) if one < 1 else 2, radius, int(most) + 1)


class Quantiser:
    """Iterative quantisations of a sample, as many side by side as are asked for, each from its own random start."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 11):
        self.mean = sample.mean(0)
        _, _, self.axes = np.linalg.svd(sample - self.mean, full_matrices=False)
        self.v = (sample - self.mean) @ self.axes.T
        self.rng, self.rounds, self.parts = np.random.default_rng(seed), rounds, []

    def matrix(self, bits: int) -> np.ndarray:
        """The first ``bits`` columns of rotations, learning those that are not there yet."""
        while sum(p.shape[1] for p in self.parts) < bits:
            r = np.linalg.qr(self.rng.normal(size=(self.v.shape[1], self.v.shape[1])))[0]
            for _ in range(self.rounds):
                u, _, w = np.linalg.svd(np.sign(self.v @ r).T @ self.v)
                r = (u @ w).T
            self.parts.append(self.axes.T @ r)
        return np.concatenate(self.parts, 1)[:, :bits]


def chance_to_differ(sample: np.ndarray, mean: np.ndarray, matrix: np.ndarray, cosine: float, seed: int = 5) -> float:
    """How often a bit differs between a vector of the sample and one at this cosine, seen from the centre of the sample.

    The other vector is made: half of them in a random direction, half in that of another vector of the sample; the
    greater of the two rates counts. Codes are centred, so this is not the angle / pi where vectors share a direction."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:2000]]
    bits = (x - mean) @ matrix > 0
    rates = []
    for v in (rng.normal(size=x.shape), np.roll(x, 1, axis=0)):
        v = v - (v * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(v, axis=1, keepdims=True)
        fit = size[:, 0] > 1e-9
        if fit.any():
            y = cosine * x[fit] + sqrt(max(0.0, 1 - cosine * cosine)) * v[fit] / size[fit]
            rates.append((bits[fit] != ((y - mean) @ matrix > 0)).mean())
    return float(min(0.5, max(rates, default=acos(cosine) / np.pi)))


def usual_cosine(sample: np.ndarray, k: int, share: float = 0.05, seed: int = 6) -> float:
    """The cosine that the k-th nearest of the sample reaches for all but ``share`` of it. With the rows that are not in the
    sample, neighbours only get nearer, so it is a careful guess for the whole collection."""
    at = np.random.default_rng(seed).permutation(len(sample))[:1000]
    c = sample[at] @ sample.T
    c[np.arange(len(at)), at] = -2.0
    k = min(k, len(sample) - 1)
    return float(np.clip(np.quantile(-np.partition(-c, k - 1, axis=1)[:, k - 1], share), 0.1, 0.999)) if k > 0 else 0.5


def merged(df: DataFrame, key: str, merge) -> DataFrame:
    """df with merge(rows) of the rows whose key is not theirs alone. Where those keys are few, the other rows are not moved."""
    often = stage(df.groupBy(key).count().filter("count > 1").select(key), "repeated")
    n = often.limit(FEW // 5 + 1).count()
    if not n:
        return df
    if n > FEW // 5:
        return merge(df)
    return df.join(F.broadcast(often), key, "left_anti").unionByName(merge(df.join(F.broadcast(often), key, "left_semi")))


def chosen(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is in ids (id, distinct), moved only where ids are many."""
    return df.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids, "id", "left_semi")


def usable_vectors(vectors: DataFrame, dimension: int | None = None, vec_id: str = "vec_id", order: str = "ord", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding): of each id the row of greatest ord (ties: the greater embedding), if it is comparable.

    Null ids, null embeddings, those of another length than ``dimension`` (by default the commonest one), with null, NaN
    or infinite values, or all zero, are left out; repeated rows count once.
    """
    v = vectors.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("string").alias("vec_id"), F.struct(F.col(order), F.col(embedding).cast("array<double>").alias("embedding")).alias("v"))
    v = merged(v, "vec_id", lambda r: r.groupBy("vec_id").agg(F.max("v").alias("v"))).select("vec_id", "v.embedding").filter("embedding IS NOT NULL")
    if dimension is None:
        top = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dimension = top["n"] if top else 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter((F.size("embedding") == dimension) & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def _fit(entries: DataFrame, rows: int, fit_rows: int, k: int, cosine: float | None, recall: float, radius: int, spread: float, per_bucket: float, words: int) -> tuple[Plan, np.ndarray, np.ndarray]:
    """The plan, the mean and the rotations, learned by one task from about ``fit_rows`` entries, fewer than twice as many:
    those whose hash falls in one of rows / fit_rows classes. Only what was learned comes to the driver."""
    sample = entries.filter(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(max(1, ceil(rows / fit_rows)))) == 0).limit(2 * fit_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in parts])
        x = np.concatenate([b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in parts])[np.argsort(ids)]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        q = Quantiser(x)
        near = usual_cosine(x, k) if cosine is None else cosine
        p = substrings_for(rows, chance_to_differ(x, q.mean, q.matrix(WORD * words), near), recall, radius, spread, per_bucket, words)
        m = q.matrix(max(WORD * words, p.bits * p.substrings))
        one = lambda v, kind: pa.array([list(v)], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([one((p.bits, p.substrings, p.radius, p.most_apart), pa.int32()), one(q.mean, pa.float64()), one(m.ravel(), pa.float64())], names=["plan", "mean", "matrix"])

    r = sample.select("id", "embedding").repartition(1).mapInArrow(fit, "plan array<int>, mean array<double>, matrix array<double>").first()
    if r is None:  # no hash fell into the class: so few rows that any of them will do
        return _fit(entries, 1, fit_rows, k, cosine, recall, radius, spread, per_bucket, words)
    return Plan(*r.plan), np.array(r.mean), np.array(r.matrix).reshape(len(r.mean), -1)


def _encoded(index: DataFrame, plan: Plan, mean: np.ndarray, matrix: np.ndarray, words: int, probing: bool) -> DataFrame:
    """(key, id, c0...): one row per vector and substring, and per probe of it. key tells value and number of a substring,
    c0... are the first bits of the code."""
    shared = index.sparkSession.sparkContext.broadcast((mean, matrix))
    masks = [0] + [sum(1 << i for i in c) for r in range(1, plan.radius + 1) for c in combinations(range(plan.bits), r)] if probing else [0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, matrix = shared.value
        weigh, mask, m = (1 << np.arange(plan.bits)).astype(np.int64), np.array(masks, np.int64), plan.substrings
        at_once = max(1, min(512, (1 << 20) // (m * len(masks))))
        for b in batches:
            for lo in range(0, b.num_rows, at_once):
                part = b.slice(lo, at_once)
                n = part.num_rows
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                bit = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ matrix > 0
                value = bit[:, : m * plan.bits].reshape(n, m, plan.bits) @ weigh
                key = (value[:, :, None] ^ mask) * m + np.arange(m)[:, None]
                code = (bit[:, : WORD * words].reshape(n, words, WORD).astype(np.uint64) << np.arange(WORD, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
                row = np.repeat(np.arange(n), m * len(mask))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column("id").take(pa.array(row)), *[pa.array(code[row, w]) for w in range(words)]], names=["key", "id", *[f"c{w}" for w in range(words)]])

    return index.select("id", "embedding").mapInArrow(encode, "key long, id long, " + ", ".join(f"c{w} long" for w in range(words)))


def _codes(entries: DataFrame, plan: Plan, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(id, w0, w1...): every bit of the index, and those that candidates are held against each other by, in words of 64."""
    shared, n = entries.sparkSession.sparkContext.broadcast((mean, matrix)), -(-matrix.shape[1] // WORD)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, matrix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                bit = np.zeros((len(x), n * WORD), bool)
                bit[:, : matrix.shape[1]] = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ matrix > 0
                word = np.packbits(bit, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(np.ascontiguousarray(word[:, w])) for w in range(n)]], names=["id", *[f"w{w}" for w in range(n)]])

    return entries.select("id", "embedding").mapInArrow(encode, "id long, " + ", ".join(f"w{w} long" for w in range(n)))


def _key(plan: Plan, j: int) -> Column:
    """The key of substring j: its value and its number."""
    w, off = divmod(j * plan.bits, WORD)
    value = F.shiftrightunsigned(f"w{w}", off)
    if off + plan.bits > WORD:
        value = value.bitwiseOR(F.shiftleft(f"w{w + 1}", WORD - off))
    return value.bitwiseAND(F.lit((1 << plan.bits) - 1)) * F.lit(plan.substrings) + F.lit(j)


def _met(codes: DataFrame, rows: int, plan: Plan, words: int, crowded: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (id, id_b), id < id_b, that agree in a substring and differ in few bits, and the ids (id) in crowded buckets,
    None without any. A few substrings are sorted at a time, and only what they find is kept."""
    each = max(1, max(PASS, PASS_EACH * rows) // rows)
    pairs = close = None
    for lo in range(0, plan.substrings, each):
        keys = F.explode(F.array(*[_key(plan, j) for j in range(lo, min(lo + each, plan.substrings))]))
        entries = codes.select(keys.alias("key"), "id", *[f"w{w}" for w in range(words)])
        full = stage(entries.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded")
        if not full.isEmpty():
            ids = stage(entries.join(full, "key", "left_semi").select("id").distinct(), "crowded")
            close = ids if close is None else close.unionByName(ids)
            entries = entries.join(full, "key", "left_anti")  # fewer than rows x substrings / crowded keys
        sides = [entries.select("key", F.col("id").alias(f"id_{s}"), *[F.col(f"w{w}").alias(f"w{w}_{s}") for w in range(words)]) for s in "ab"]
        differ = sum((F.bit_count(F.col(f"w{w}_a").bitwiseXOR(F.col(f"w{w}_b"))) for w in range(1, words)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
        near = sides[0].hint("merge").join(sides[1], "key").filter((F.col("id_a") < F.col("id_b")) & (differ <= plan.most_apart))
        part = stage(near.select(F.col("id_a").alias("id"), "id_b").distinct(), "met")
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs, close if close is None else close.distinct()


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)), -1.0, 1.0)


def exact_neighbours(vectors: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(id, id_b, cosine): the k most similar others, ties of the k-th included, of each row of (id, embedding, asked) whose
    asked is true, exactly.

    Every vector goes to the cell of the nearest of at most CELLS pivots, and cells are cut into blocks of about BLOCK by
    hash. Two blocks meet in one task, of which only the best k of each row come out; with ``least``, blocks are left out
    whose cells are too far apart for it by the triangle inequality of angles. The work grows with the square of the rows
    that are near each other, the memory of a task does not.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    few = vectors.filter(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(max(1, rows // (2 * CELLS)))) == 0).select("embedding").limit(CELLS).collect()
    if not few:
        few = vectors.select("embedding").limit(1).collect()
    if not few:
        return spark.createDataFrame([], "id long, id_b long, cosine double")
    pivots = np.array([r.embedding for r in few])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value.T
                cell = c.argmax(1)
                far = np.arccos(np.clip(c[np.arange(len(x)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "embedding", "asked", "cell", "far"])

    placed = stage(vectors.select("id", "embedding", "asked").mapInArrow(place, "id long, embedding array<double>, asked boolean, cell int, far double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()  # at most CELLS
    blocks = {r.cell: ceil(r.n / BLOCK) for r in cells}
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = np.pi if least is None else acos(max(-1.0, min(1.0, least))) + 1e-6
    near = [(a.cell, b.cell) for i, a in enumerate(cells) for b in cells[i:] if between[a.cell, b.cell] - a.radius - b.radius <= reach]
    sizes = F.create_map(*[F.lit(v) for c, n in blocks.items() for v in (c, n)])
    table = spark.createDataFrame(near, "cell_a int, cell_b int")
    table = table.withColumn("a", F.explode(F.sequence(F.lit(0), sizes[F.col("cell_a")] - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), sizes[F.col("cell_b")] - 1)))
    table = table.filter("cell_a < cell_b OR a <= b").withColumn("pair", F.concat_ws(":", "cell_a", "a", "cell_b", "b"))
    sides = table.select("pair", F.col("cell_a").alias("cell"), F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        table.filter("cell_a <> cell_b OR a <> b").select("pair", F.col("cell_b").alias("cell"), F.col("b").alias("block"), F.lit(1).alias("side")))
    held = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(31), "id"), sizes[F.col("cell")]).cast("int"))

    def best(t: pa.Table) -> pa.Table:
        side, ids, asked = (t.column(c).to_numpy() for c in ("side", "id", "asked"))
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for mine, other in ((left, right), (right, left))[: 1 if right is left else 2]:
            mine = mine[asked[mine].astype(bool)]
            for lo in range(0, len(mine), 1024):
                m = mine[lo : lo + 1024]
                c = u[m] @ u[other].T
                c[m[:, None] == other[None, :]] = -2.0
                top = min(k, len(other))
                bar = np.partition(c, len(other) - top, axis=1)[:, len(other) - top] - 1e-12 if top else np.full(len(m), 9.0)
                i, j = np.nonzero(c >= np.maximum(bar, -1.5 if least is None else least - 1e-9)[:, None])
                found.append((m[i], other[j]))
        i, j = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, int) for s in (0, 1))
        return pa.table({"id": ids[i], "id_b": ids[j], "cosine": cosines(x[i], x[j])})

    met = held.join(sides, ["cell", "block"]).select("pair", "side", "id", "embedding", "asked")
    return met.groupBy("pair").applyInArrow(best, "id long, id_b long, cosine double")


def nearest(vectors: DataFrame, k: int = 5, cosine: float | None = 0.95, recall: float = 0.999, radius: int = 0, spread: float = 7.0, per_bucket: float = 4,
            words: int = 3, least: float | None = None, queries: DataFrame | None = None, fit_rows: int = 10_000, crowded: int = CROWDED) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): the k most similar other vectors of each query vector, ties by neighbour id.

    vectors is (vec_id, embedding), as `usable_vectors` gives it; queries (vec_id) restricts whose neighbours come out,
    without it they are those of every vector. The index is planned to retrieve pairs of ``cosine`` with ``recall``
    (and closer ones more surely), those that nearly all k-th neighbours of the sample reach if cosine is None;
    pairs below ``least`` are left out. An empty table gives no rows.

    Rotations are learned from at most 2 x ``fit_rows`` vectors, chosen by hash; every vector is indexed. Equal embeddings
    are one entry of the index; of a large group of copies only the k + 1 least ids can be anyone's neighbours. Entries of
    a bucket of more than ``crowded`` are compared with all others of such buckets by `exact_neighbours` instead, so
    crowding loses nothing, and an entry has at most crowded x substrings (x probes) candidates, which bounds what is joined by its id.
    """
    named = stage(vectors.withColumn("class", F.xxhash64("embedding")).select("vec_id", "class", "embedding"), "vectors")
    members = named.select("vec_id", "class")
    entries = merged(named.select(F.col("class").alias("id"), "embedding"), "id", lambda r: r.groupBy("id").agg(F.min("embedding").alias("embedding")))
    rows = entries.count()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "vec_id string, neighbour string, cosine double, rank int")
    plan, mean, matrix = _fit(entries, rows, fit_rows, k, cosine, recall, radius, spread, per_bucket, words)
    asked = entries
    if queries is not None:
        ids = members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
        asked = stage(entries.join(ids.select(F.col("class").alias("id")).distinct(), "id", "left_semi"), "asked")
    by_pair = queries is None and not plan.radius  # without probes each pair meets once
    if by_pair:
        codes = stage(_codes(entries, plan, mean, matrix), "codes")
        pairs, close = _met(codes, rows, plan, words, crowded)
        unstage(codes)
        pairs = stage(pairs.distinct(), "pairs")
        some = close is not None
        asked = chosen(entries, stage(pairs.select("id").union(pairs.select("id_b")).distinct(), "met"))
        others = asked
    else:
        stored = _encoded(entries, plan, mean, matrix, words, False)
        full = stage(stored.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded")
        some, others = not full.isEmpty(), entries
        cold = stored.join(full, "key", "left_anti") if some else stored  # fewer than rows x substrings / crowded keys
        codes = [f"c{w}" for w in range(words)]
        other = cold.select("key", F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in codes])
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in codes[1:]), F.bit_count(F.col("c0").bitwiseXOR(F.col("c0_b"))))
        apart = F.col("id") < F.col("id_b") if queries is None else F.col("id") != F.col("id_b")
        pairs = _encoded(asked, plan, mean, matrix, words, True).hint("merge").join(other, "key").filter(apart & (differ <= plan.most_apart)).select("id", "id_b").distinct()
    a = asked.select("id", F.col("embedding").alias("x"))
    b = others.select(F.col("id").alias("id_b"), F.col("embedding").alias("y"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (t.column(c).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in "xy")
                yield pa.RecordBatch.from_arrays([t.column("id"), t.column("id_b"), pa.array(cosines(x, y))], names=["id", "id_b", "cosine"])

    scored = pairs.join(a, "id").join(b, "id_b").select("id", "id_b", "x", "y").mapInArrow(score, "id long, id_b long, cosine double")
    if least is not None:
        scored = scored.filter(F.col("cosine") >= least)
    if queries is None:
        scored = stage(scored, "scored")
        scored = scored.unionByName(scored.select(F.col("id_b").alias("id"), F.col("id").alias("id_b"), "cosine"))
    if some:
        close = (close if by_pair else stored.join(full, "key", "left_semi").select("id").distinct()).withColumn("asked", F.lit(queries is None))
        if not by_pair:
            probed = _encoded(asked, plan, mean, matrix, words, True).join(full, "key", "left_semi").select("id").distinct()
            close = close.unionByName(probed.withColumn("asked", F.lit(True))).groupBy("id").agg(F.max("asked").alias("asked"))
        exact = exact_neighbours(stage(entries.join(close, "id"), "crowded"), k, least)
        scored = scored.unionByName(exact if least is None else exact.filter(F.col("cosine") >= least)).groupBy("id", "id_b").agg(F.max("cosine").alias("cosine"))
    # equal cosines are told apart by ids of members, so ties of the k-th stay in
    tied = F.rank().over(Window.partitionBy("id").orderBy(F.desc("cosine")))
    top = scored.withColumn("r", tied).filter(F.col("r") <= k).drop("r")
    first = Window.partitionBy("class").orderBy("vec_id")
    targets = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select(F.col("class").alias("id_b"), F.col("vec_id").alias("neighbour"))
    own = targets.select(F.col("id_b").alias("id"), F.struct(F.lit(-1.0).alias("c"), "neighbour").alias("t"))
    if queries is not None:
        own = own.join(asked.select("id"), "id", "left_semi")
    lists = top.join(targets, "id_b").select("id", F.struct((-F.col("cosine")).alias("c"), "neighbour").alias("t")).unionByName(own)
    # k classes and the ties of the k-th, with k + 1 targets each, and the own one
    lists = lists.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("all")).withColumnRenamed("id", "class").hint("merge")
    who = members if queries is None else members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    out = salted_join(who, lists, ["class"], F.col("vec_id"), "inner")
    mine = F.slice(F.filter("all", lambda t: t["neighbour"] != F.col("vec_id")), 1, k)
    out = out.select("vec_id", F.posexplode(mine).alias("p", "t"))
    return out.select("vec_id", F.col("t.neighbour").alias("neighbour"), (-F.col("t.c")).alias("cosine"), (F.col("p") + 1).cast("int").alias("rank"))


def close_pairs(neighbours: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of at least this cosine of which one is among the other's neighbours."""
    near = neighbours.filter(F.col("cosine") >= cosine)
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
