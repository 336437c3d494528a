"""How much a term marks its document (problem 2): parsimonious language models.

A document's terms are taken to come from a mixture of its own model and that of the collection. Expectation
maximisation moves mass that the collection explains away from the document's model; the probabilities it converges to
rank the document's terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.operators.skew import salted_join

#: A background of so many terms, a few dozen megabytes, goes to every task; a greater one is joined.
MOST_TERMS = 200_000
#: Rows that go through expectation maximisation at once.
AT_ONCE = 1 << 17


def parsimonious(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, own_share: float, tolerance: float, rounds: int) -> np.ndarray:
    """The converged probabilities of the terms of many documents at once; document i begins at starts[i].

    A document stops by itself, whatever shares its batch; those that have stopped leave the arrays."""
    sizes = np.diff(np.append(starts, len(tf)))
    total = np.add.reduceat(tf, starts)
    result = tf / np.repeat(np.maximum(total, 1e-300), sizes)
    at, p, noise = np.arange(len(tf)), result.copy(), (1 - own_share) * background
    for _ in range(rounds):
        own = own_share * p
        expected = tf * own / np.maximum(own + noise, 1e-300)
        new = expected / np.repeat(np.maximum(np.add.reduceat(expected, starts), 1e-300), sizes)
        live = np.maximum.reduceat(np.abs(new - p), starts) > tolerance
        p = new
        if not live.all():
            result[at] = p
            stay = np.repeat(live, sizes)
            at, p, tf, noise, sizes = at[stay], p[stay], tf[stay], noise[stay], sizes[live]
            if not len(sizes):
                return result
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    result[at] = p
    return result


def term_models(postings: DataFrame, own_share: float = 0.1, tolerance: float = 1e-6, rounds: int = 200, marks: float | None = None, together: bool = False,
                vocabulary: int | None = None) -> DataFrame:
    """(doc_id, term, tf, doc_tf, documents, background, probability, rank) for every row of (term, doc_id, tf).

    background is the term's share of all occurrences of the collection, probability the term's converged share of the
    document's own model, and rank orders a document's terms by it, to nine digits (ties: the smaller background, then the
    term). A term whose tf is not positive has probability 0; so have all terms of a document without positive tf.

    marks: only the terms come out that the converged models leave at least what a term of this share of its document must
    keep. As the share falls towards marks - background x (1 - own_share) / own_share in every round, and never below, no
    such term is missed; as the probabilities of a document add up to 1, it is among the first ones by rank.

    Background and document counts of up to MOST_TERMS terms go to all tasks, else they are joined by term, with the
    postings of hot terms salted. Rows of one document meet in one task, sorted, and are streamed through it: a document
    must fit there, its neighbours need not. together: the postings are partitioned by document already, as `counted_postings`
    leaves them on request, and are not shuffled again. vocabulary: the number of terms, where the caller knows it cheaper.
    """
    counts = postings.groupBy("term").agg(F.sum("tf").alias("__cf"), F.count("*").alias("documents"))
    # both sums are used, so that this is read from the same exchange as the counts
    every = counts.agg(F.coalesce(F.sum("__cf"), F.lit(0)).cast("double").alias("__all"), F.sum("documents").alias("__rows"))
    share = F.when((F.col("__rows") > 0) & (F.col("__all") > 0), F.col("__cf") / F.col("__all")).otherwise(0.0)
    background = counts.join(F.broadcast(every)).select("term", "documents", share.alias("background"))
    few = (postings.select(F.approx_count_distinct("term", 0.02)).first()[0] if vocabulary is None else vocabulary) <= MOST_TERMS
    if few:
        rows = postings.join(F.broadcast(background), "term")
    else:
        rows = salted_join(postings, background, ["term"], F.col("doc_id"), "inner")
    if not (few and together):
        rows = rows.repartition("doc_id")
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "term", "tf", "documents", "background"]
    rows = rows.select(*names).sortWithinPartitions("doc_id", "term")

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc = t.column("doc_id").combine_chunks()
        ids = doc.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(starts, len(ids)))
        tf = np.maximum(t.column("tf").to_numpy().astype(float), 0)
        bg = t.column("background").to_numpy()
        p = parsimonious(tf, bg, starts, own_share, tolerance, rounds)
        of = np.repeat(np.arange(len(starts)), sizes)
        order = np.lexsort((np.arange(len(p)), bg, -np.round(p, 9), of))
        rank = np.empty(len(p), np.int32)
        rank[order] = np.arange(len(p)) - starts[of[order]] + 1
        out = pa.RecordBatch.from_arrays(
            [doc, *[t.column(n).combine_chunks() for n in ("term", "tf")], pa.array(np.repeat(np.add.reduceat(tf, starts), sizes).astype(np.int64)), t.column("documents").combine_chunks(), pa.array(bg), pa.array(p), pa.array(rank)],
            names=["doc_id", "term", "tf", "doc_tf", "documents", "background", "probability", "rank"],
        )
        if marks is None:
            return out
        floor = marks - bg * (1 - own_share) / own_share
        return out.filter(pa.array((p >= floor - 1e-9) & (rank * (floor - 2e-9) <= 1 + 1e-6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= AT_ONCE:
                t = pa.Table.from_batches(held)
                ids = t.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
                end = int(np.flatnonzero(ids == ids[-1])[0])  # the last document may go on
                if end:
                    yield solve(t.slice(0, end))
                held = t.slice(end).to_batches()
                size = t.num_rows - end
        if size:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"doc_id {kind}, term string, tf long, doc_tf long, documents long, background double, probability double, rank int")


def found_terms(postings: DataFrame, together: bool = False, vocabulary: int | None = None, least_tf: int = 3, least_share: float = 1 / 25, least_documents: int = 2, most_documents: int = 8) -> DataFrame:
    """(doc_id, term): the terms that the converged models rank as marking their document, at the stated counts.

    A term of ``least_share`` of its document keeps what `term_models` asks of it, so its models give all candidates, and
    the counts are exact."""
    exact = (F.col("tf") >= least_tf) & (F.col("tf") * round(1 / least_share) >= F.col("doc_tf")) & F.col("documents").between(least_documents, most_documents)
    return term_models(postings, marks=least_share, together=together, vocabulary=vocabulary).filter(exact & (F.col("probability") > 0)).select("doc_id", "term").distinct()
