"""Near-duplicate records with small edits (problem 7): order MinHash and banded alignment.

A sketch samples the least of a text's occurrence-labelled k-mers of words by a seeded hash and keeps them in text order,
so that two texts share it if they share the k-mers and their order. Pairs that share a sketch are aligned in a band in
text order, which settles the texts whose words kept their order; what it leaves open is settled by the sets of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.llm.terms import WORD, words
from sparkir.operators.skew import salted_join
from sparkir.session import cut, stage

PARITY_WORDS = 4
#: Elements of padded texts aligned at once.
ALIGNED = 1 << 19
#: A word of so few texts is telling in a collection of any size.
FEW = 100
#: Texts of fewer distinct words are not sampled but paired by their rarest words.
SHORT = 12
#: Classes whose sketches are counted beforehand, to find keys that are far too large for a task.
LOOK_AHEAD = 10_000_000
SEEN = 1000
#: Classes of one key that a task holds and compares, at most; about 15 MB.
HELD = 200_000
#: Keys of more rows are compared in blocks of rows, so many pairs at once; smaller ones side by side.
SIDE_BY_SIDE = 24
TILE = (64, 2048)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def labelled(word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words with the number of their occurrence in their text: the second "the" differs from the first."""
    order = np.lexsort((np.arange(len(word)), word, of))
    w, d = word[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    nth = np.empty(len(w), np.uint64)
    nth[order] = np.arange(len(w)) - first
    return mix(word ^ mix(nth, 1), 2)


def k_mers(word: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the runs of k words of each text; a text of fewer words is one run."""
    sizes = np.diff(np.append(starts, len(word)))
    h = word.astype(np.uint64)
    for i in range(1, k):
        ahead = np.concatenate([word[i:], np.zeros(i, word.dtype)]).astype(np.uint64)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(word)) > i  # the run stays inside its text
        h = np.where(left, mix(h ^ mix(ahead, 20 + i), 21), h)
    counts = np.maximum(sizes - (k - 1), 1)
    keep = np.arange(len(word)) - np.repeat(starts, sizes) < np.repeat(counts, sizes)
    return h[keep], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def order_sketches(item: np.ndarray, starts: np.ndarray, weight: np.ndarray | None, sketches: int, kept: int, seed: int = 100) -> np.ndarray:
    """One key per text and sketch: the ``kept`` labelled items of least (weighted) hash, in text order."""
    sizes = np.diff(np.append(starts, len(item)))
    of = np.repeat(np.arange(len(starts)), sizes)
    out = np.zeros((len(starts), sketches), np.uint64)
    for s in range(sketches):
        r = (mix(item, seed + s) >> np.uint64(11)).astype(float)
        if weight is not None:
            r = -np.log1p(r * -(2.0**-53)) / weight  # the least of exponentials: an item is sampled in proportion to its weight
        at = []
        for _ in range(kept):
            hit = np.flatnonzero(r == np.repeat(np.minimum.reduceat(r, starts), sizes))
            place = np.full(len(starts), -1)
            place[of[hit][::-1]] = hit[::-1]  # the first of equal ones
            place[~np.isfinite(r[place])] = -1
            at.append(place)
            r[place[place >= 0]] = np.inf
        at = np.sort(np.stack(at, 1), 1)
        key = np.full(len(starts), seed + s, np.uint64)
        for i in range(kept):
            key = mix(key ^ np.where(at[:, i] >= 0, item[at[:, i]], np.uint64(0)), 3 + i)
        out[:, s] = key
    return out.view(np.int64)


def parities(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, PARITY_WORDS) bits: whether an odd number of a text's distinct words falls into each of 64 x PARITY_WORDS slots."""
    n = 64 * PARITY_WORDS
    slot = np.repeat(np.arange(len(sizes)), sizes) * n + (mix(word, 9) % np.uint64(n)).astype(np.int64)
    odd = np.bincount(slot, minlength=len(sizes) * n).reshape(len(sizes), PARITY_WORDS, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def _possible(t: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of columns of t (key, id, n, parity words) those whose sizes and parities allow the similarity."""
    ids, n, p = t[1], t[2], t[3:].view(np.uint64)
    ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (ids[i] != ids[j])
    i, j = i[ok], j[ok]
    most, apart = (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-9, np.zeros(len(i), np.int64)
    for word in p:
        apart += np.bitwise_count(word[i] ^ word[j])
        ok = apart <= most
        i, j, most, apart = i[ok], j[ok], most[ok], apart[ok]
    return i, j


def _in_tiles(t: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The possible pairs of the columns of t, which share a key: all with all in tiles, in the order of their sizes, so that
    tiles of sizes too far apart are left out."""
    t = t[:, np.argsort(t[2], kind="stable")]
    n, first, rate = t[2], t[3].view(np.uint64), (1 - similarity) / (1 + similarity)
    for lo in range(0, len(n), TILE[0]):
        hi = min(lo + TILE[0], len(n))
        end = int(np.searchsorted(n, (n[hi - 1] + 1e-9) / similarity + 1e-9, "right"))
        for left in range(lo, end, TILE[1]):
            right = min(left + TILE[1], end)
            apart = np.bitwise_count(first[lo:hi, None] ^ first[None, left:right])
            at = np.flatnonzero(apart <= min(64, int((n[hi - 1] + n[right - 1]) * rate + 1e-9)))
            i, j = lo + at // (right - left), left + at % (right - left)
            i, j = _possible(t, i[j > i], j[j > i], similarity)
            if len(i):
                yield t[1][i], t[1][j]


def meetings(batches: Iterator[pa.RecordBatch], bucket: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id, id_b), id < id_b, of rows (key, id, n, p0, and more parity words if there are) that come sorted by key: pairs of one
    key whose sizes and parity words allow the similarity. A key of more than ``bucket`` rows is crowded: its rows come out
    with id_b null (-1).

    The rows are streamed; of an unfinished key no more than bucket + 1 are held."""
    held = None
    crowded = None  # the key whose further rows are known to be crowded

    def settle(t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, ids = t[:2]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(new, len(key)))
        run = np.repeat(sizes, sizes)
        many = run > bucket
        if many.any():
            yield ids[many], np.full(int(many.sum()), -1)
        end = np.repeat(new + sizes, sizes)
        at = np.flatnonzero((run > 1) & (run <= SIDE_BY_SIDE) & ~many)
        for step in range(1, int(run[at].max(initial=1))):
            at = at[at + step < end[at]]
            i, j = _possible(t, at, at + step, similarity)
            yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero((sizes > SIDE_BY_SIDE) & (sizes <= bucket)):
            for x, y in _in_tiles(t[:, new[k] : new[k] + sizes[k]], similarity):
                found.append((np.minimum(x, y), np.maximum(x, y)))
                if len(found) >= 100:  # a tile has at most 131,072 pairs
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found.clear()
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))

    for b in batches:
        names = ("key", "id", "n", *sorted(x for x in b.schema.names if x[0] == "p"))
        t = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        if crowded is not None:
            same = t[0] == crowded
            if same.any():
                yield t[1][same], np.full(int(same.sum()), -1)
                t = t[:, ~same]
            if t.shape[1]:
                crowded = None
        if held is not None:
            t = np.concatenate([held, t], 1)
        if not t.shape[1]:
            continue
        last = int(np.searchsorted(t[0], t[0][-1]))
        yield from settle(t[:, :last])
        held = t[:, last:]
        if held.shape[1] > bucket:
            crowded = int(held[0, 0])
            yield held[1], np.full(held.shape[1], -1)
            held = held[:, :0]
    if held is not None:
        yield from settle(held)


def matches_in_band(a: list[np.ndarray], b: list[np.ndarray], band: np.ndarray) -> np.ndarray:
    """Of each pair (a[i], b[i]) the most equal elements that an alignment in order can pair, if it stays within band[i] of
    the diagonal, or some wider band of a pair that is aligned together with it.

    Of two sorted sets that share all but d elements of each this is the number of shared elements at any band >= d, as
    the places of a shared element differ by at most d. Pairs of like length are aligned side by side.
    """
    out = np.zeros(len(a), np.int64)
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(a, b)], np.int64)
    order, lo = np.argsort(longest, kind="stable"), 0
    by_length = longest[order]
    while lo < len(order):
        alike = np.searchsorted(by_length, by_length[lo] * 1.2, "right")  # padding stays small
        hi = lo + max(1, min(alike - lo, int(ALIGNED // (by_length[alike - 1] * 2))))
        pick = order[lo:hi]
        rows, cols, w = max(len(a[i]) for i in pick), max(len(b[i]) for i in pick), int(max(band[i] for i in pick)) + 1
        x, y = np.zeros((len(pick), rows), np.int64), np.zeros((len(pick), cols + 2 * w + rows + 1), np.int64)
        real_x, real_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for k, i in enumerate(pick):
            x[k, : len(a[i])], y[k, w : w + len(b[i])] = a[i], b[i]
            real_x[k, : len(a[i])], real_y[k, w : w + len(b[i])] = True, True
        best, top = np.zeros((len(pick), 2 * w + 2), np.int32), np.zeros(len(pick), np.int32)
        for i in range(rows):  # column o stands for element i + o - w of b
            same = (y[:, i : i + 2 * w + 1] == x[:, i : i + 1]) & real_y[:, i : i + 2 * w + 1] & real_x[:, i : i + 1]
            step = np.maximum(best[:, :-1] + same, best[:, 1:])
            best[:, :-1] = np.maximum.accumulate(step, axis=1)
            best[:, -1] = best[:, -2]
            np.maximum(top, best[:, -2], out=top)
        out[pick] = top
        lo = hi
    return out


def texts_as_words(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seq, n, h1, h2): hashed words in order, the number of the distinct ones and the hash of their set; texts without
    a word are left out."""
    seq = F.transform(words(text), lambda w: F.xxhash64(w))
    some = F.col(doc).isNotNull() & F.lower(F.col(text)).rlike(WORD)  # a filter on n would take every text apart twice
    w = documents.filter(some).select(F.col(doc).cast("long").alias("doc_id"), seq.alias("seq")).withColumn("bag", F.sort_array(F.array_distinct("seq")))
    w = w.withColumn("n", F.size("bag"))
    return w.select("doc_id", "seq", "n", F.xxhash64("bag").alias("h1"), F.xxhash64(F.lit(1), "bag").alias("h2"))


def near_duplicates(documents: DataFrame, least_words: int = 1, similarity: float = 0.8, sketches: int = 28, kept: int = 2,
                    common: float = 0.01, plain: int = 12, plain_kept: int = 3, k: int = 2, bucket: int = 500) -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: (doc_id, class_id, paired), one row per text with a word; paired: it has at least
    ``least_words`` distinct words. pairs: (class_a, class_b, similarity, order_similarity), class_a < class_b, all pairs of
    classes of such texts found whose shared distinct words are at least ``similarity`` of the distinct words of both.

    Texts of the same distinct words are one class, named after its least doc_id, before anything is compared. Null and
    blank texts and null ids are left out; of rows that repeat a doc_id with different texts the row of the least hash counts.

    Two families of sketches are taken: ``sketches`` of ``kept`` words at their first occurrence, which follow the distinct
    words however often a text repeats them, and ``plain`` ones of ``plain_kept`` occurrence-labelled ``k``-mers, which tell
    large groups of near-copies apart whose words are frequent by themselves. Sampling weights of words in more than
    ``common`` of the texts (and more than FEW) fall with their frequency in the first family; there are at most (mean
    distinct words / common) such words, and only their table goes to the tasks. A pair of similarity s shares a given sketch
    of the first family with about s ** kept times the chance that the sampled words kept their order.

    Rows of a sketch's key meet sorted in one stream. Before verification, pairs are pruned without loss by their sizes and by
    parity bitmaps: each word of only one side flips one bit, so more different bits than words allowed rule a pair out.
    Keys of more than ``bucket`` classes and a hundredth of all (at most HELD) are not paired as they are: their classes are
    paired by the rarest words of which a similar pair must share one, exactly, salted where such a word is hot. So are texts of fewer than SHORT
    distinct words and those that can be similar to them, which are too short to be sampled.

    Verification aligns the distinct words in text order, in a band as wide as the similarity allows: what it pairs is shared,
    so it accepts texts that kept their order. The rest is decided by the same alignment of the sorted words, which is the
    exact similarity. order_similarity is that of the first alignment.
    """
    docs = stage(texts_as_words(documents), "words")
    once = docs.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("h")).select("doc_id", "h.h1", "h.h2", (F.col("h.n") >= least_words).alias("paired"))
    ids = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"))
    members = cut(salted_join(once, ids, ["h1", "h2"], F.col("doc_id"), "inner").select("doc_id", "class_id", "paired", "h1", "h2"))
    heads = members.filter("paired AND doc_id = class_id").select("doc_id", "h1", "h2")
    reps = stage(docs.join(heads, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("class_id"), "seq", "n"), "classes")
    total = reps.count()
    counts = reps.select(F.explode(F.array_distinct("seq")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    bound = max(FEW, common * total)
    often = counts.filter(F.col("df") > bound).collect()
    table = np.array(sorted((r.word, r.df) for r in often), dtype=np.int64).reshape(-1, 2)
    shared = documents.sparkSession.sparkContext.broadcast((table[:, 0].copy(), (bound / np.maximum(table[:, 1], 1)) ** 2))

    def sketch(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, factor = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            every, first = b.column("seq"), b.column("firsts")
            flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
            begin = lambda c: np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
            word, starts = flat(first), begin(first)
            weight = np.ones(len(word))
            if len(known):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                weight = np.where(known[at] == word, factor[at], 1.0)
            keys = order_sketches(mix(word), starts, weight, sketches, kept)
            runs, at = k_mers(flat(every), begin(every), k)
            of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(runs))))
            keys = np.concatenate([keys, order_sketches(labelled(runs, of), at, None, plain, plain_kept, 500)], axis=1)
            odd = parities(word.view(np.uint64), first.value_lengths().to_numpy(zero_copy_only=False))
            row, key = np.repeat(np.arange(b.num_rows), keys.shape[1]), keys.ravel()
            ids, n = b.column("class_id").to_numpy(zero_copy_only=False)[row], b.column("n").to_numpy(zero_copy_only=False)[row].astype(np.int32)
            if len(hot):  # known to be crowded: spread over all tasks
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                crowd = hot[at] == key
                key, n = np.where(crowd, mix(ids, 77).view(np.int64), key), np.where(crowd, -1, n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(n), *[pa.array(odd[row, i]) for i in range(PARITY_WORDS)]], names=["key", "id", "n", *[f"p{i}" for i in range(PARITY_WORDS)]])

    bands = "key long, id long, n int, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS))
    most = max(bucket, min(HELD, total // 100))
    source = reps.select("class_id", "seq", F.array_distinct("seq").alias("firsts"), "n")
    hot = np.zeros(0, np.int64)
    if total > LOOK_AHEAD:  # keys that hold much more than a task should are looked for in a sample; they are crowded either way
        rate = ceil(total / LOOK_AHEAD)
        some = source.filter(F.pmod(F.xxhash64(F.lit(3), "class_id"), F.lit(rate)) == 0).mapInArrow(lambda t: sketch(t, np.zeros(0, np.int64)), bands)
        found = some.groupBy("key").count().filter(F.col("count") > max(SEEN, 4 * most / rate)).select("key").collect()  # at most LOOK_AHEAD x sketches / SEEN
        hot = np.array(sorted(r.key for r in found), np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    crowd = b.column("n").to_numpy(zero_copy_only=False) < 0
                    if crowd.any():
                        lost.append(b.column("id").to_numpy(zero_copy_only=False)[crowd])
                        b = b.filter(pa.array(~crowd))
                    yield b

        lost: list[np.ndarray] = []
        for i, j in meetings(known(), most, similarity):
            for ids in lost:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), -1))], names=["id", "id_b"])
            lost.clear()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["id", "id_b"])
        for ids in lost:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), -1))], names=["id", "id_b"])

    met = source.mapInArrow(lambda t: sketch(t, hot), bands).repartition("key").sortWithinPartitions("key").mapInArrow(meet, "id long, id_b long")
    met = stage(met.distinct(), "met")
    cand = met.filter("id_b <> -1")
    crowd = met.filter("id_b = -1").select("id")
    if not crowd.isEmpty():
        cand = cand.unionByName(_by_rare_words(reps.join(crowd.withColumnRenamed("id", "class_id"), "class_id", "left_semi"), counts, similarity))
    if least_words < SHORT:
        cand = cand.unionByName(_by_rare_words(reps.filter(F.col("n") * similarity < SHORT), counts, similarity))
    if not crowd.isEmpty() or least_words < SHORT:
        cand = cand.distinct()
    a = reps.select(F.col("class_id").alias("id"), F.array_distinct("seq").alias("seq_a"))
    b = reps.select(F.col("class_id").alias("id_b"), F.array_distinct("seq").alias("seq_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            def split(name: str) -> list[np.ndarray]:
                c = t.column(name)
                flat, off = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(zero_copy_only=False)
                return [flat[off[i] : off[i + 1]] for i in range(t.num_rows)]

            x, y = split("seq_a"), split("seq_b")
            both = np.array([len(p) + len(q) for p, q in zip(x, y)])
            band = (both * (1 - similarity) / (1 + similarity)).astype(int) + 1
            ordered = matches_in_band(x, y, band)
            enough = lambda m, of: m >= similarity * (of - m) - 1e-9
            kept = enough(ordered, both)
            at = np.flatnonzero(~kept)
            exact = matches_in_band([np.sort(x[i]) for i in at], [np.sort(y[i]) for i in at], band[at])
            kept[at] = enough(exact, both[at])
            shared_words = np.zeros(len(both), np.int64)
            shared_words[at] = exact
            sure = np.setdiff1d(np.flatnonzero(kept), at)
            shared_words[sure] = [len(np.intersect1d(x[i], y[i], assume_unique=True)) for i in sure]
            i = np.flatnonzero(kept)
            m = shared_words[i]
            yield pa.RecordBatch.from_arrays([t.column("id").take(pa.array(i)), t.column("id_b").take(pa.array(i)), pa.array(m / (both[i] - m)), pa.array(ordered[i] / (both[i] - ordered[i]))], names=["class_a", "class_b", "similarity", "order_similarity"])

    found = cand.join(a, "id").join(b, "id_b").select("id", "id_b", "seq_a", "seq_b").mapInArrow(verify, "class_a long, class_b long, similarity double, order_similarity double")
    return members.select("doc_id", "class_id", "paired"), found


def _by_rare_words(crowd: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """(id, id_b), id < id_b: pairs of ``crowd`` (class_id, seq, n) that share one of their rarest words; similar ones must, by
    the pigeonhole principle."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = b.column("firsts")
                bits = parities(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), c.value_lengths().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("class_id"), b.column("n"), *[pa.array(bits[:, i]) for i in range(PARITY_WORDS)]], names=info)

    info = ["id", "n", *[f"p{i}" for i in range(PARITY_WORDS)]]
    texts = crowd.select("class_id", F.array_distinct("seq").alias("firsts"), "n")
    facts = texts.mapInArrow(signed, "id long, n int, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS)))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY_WORDS)])
    possible = (F.col("id") < F.col("id_b")) & (F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9) & (apart <= (F.col("n") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    w = texts.select(F.col("class_id").alias("id"), F.explode("firsts").alias("word"), F.col("n").alias("m"))
    ranked = salted_join(w, counts, ["word"], F.col("id"), "inner").groupBy("id", "m").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("t"))
    some = ranked.select("id", F.explode(F.slice("t", 1, (F.col("m") - F.ceil(F.lit(similarity) * F.col("m") - 1e-9) + 1).cast("int"))["word"]).alias("word")).join(facts, "id")
    some = cut(some)
    other = some.select("word", *[F.col(c).alias(f"{c}_b") for c in info])
    return salted_join(some, other, ["word"], F.col("id"), "inner", least=20_000).filter(possible).select("id", "id_b")


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the pairs of documents behind pairs of classes, and those inside a class."""
    members = members.filter("paired").select("doc_id", "class_id")
    members, pairs = cut(members), cut(pairs.select("class_a", "class_b"))  # the joins below read them more than once
    a = members.select(F.col("class_id").alias("class_a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("doc_id").alias("y"))
    # classes may be large: the members are split, the pairs of classes repeated
    across = salted_join(a, pairs, ["class_a"], F.col("x"), "inner")
    across = salted_join(across, b, ["class_b"], F.col("x"), "inner").select("x", "y")
    inside = salted_join(members.withColumnRenamed("doc_id", "x"), members.withColumnRenamed("doc_id", "y"), ["class_id"], F.col("x"), "inner").filter("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def duplicate_groups(members: DataFrame, pairs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id, group_id, links): one row per member and, with ``documents``, per document id without words, which
    is a class of its own. group_id is the least class_id that a chain of similar classes leads to, links the number of
    other classes that the document's class is similar to."""
    if documents is not None:
        every = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        members = every.join(members, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    pairs = cut(pairs.select("class_a", "class_b"))
    edges = pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).unionByName(pairs.select(F.col("class_b").alias("a"), F.col("class_a").alias("b")))
    links = edges.groupBy("a").agg(F.count("*").alias("links"))
    label = cut(links.select(F.col("a").alias("node"), F.col("a").alias("label")))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        if new.filter("label <> old").isEmpty():
            break
        label = new.select("node", "label")
    groups = new.join(links, new["node"] == links["a"]).select(F.col("node").alias("class_id"), F.col("label").alias("group_id"), "links")
    out = salted_join(members, groups, ["class_id"], F.col("doc_id"), "left")
    return out.select("doc_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
