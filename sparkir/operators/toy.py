"""Minimal scans and a minimal index over short literal texts; whole-table operators without analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.text import lowered, regex_tokens, whitespace_tokens


def scan(documents: DataFrame, terms: list[str], mode: str) -> DataFrame:
    """(doc_id) whose white-space tokens, case kept, hold all (and), any (or) or none (not) of the terms."""
    mode = checks.one_of("mode", mode, ("and", "or", "not"))
    words = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    t = whitespace_tokens("text")
    held = F.size(F.array_intersect(t, words))
    keep = held == F.size(F.array_distinct(words)) if mode == "and" else held > 0 if mode == "or" else held == 0
    return documents.filter(keep).select("doc_id")


def simple_index(documents: DataFrame) -> DataFrame:
    """(term, doc_ids, positions): every document of a lower-cased term, ascending, with its positions there."""
    t = documents.select("doc_id", F.posexplode(lowered(regex_tokens("text"))).alias("pos", "term"))
    per = t.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    # a term's documents are gathered, as this index is for short literal collections
    each = per.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "positions"))).alias("d"))
    return each.select("term", F.transform("d", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("d", lambda x: x["positions"]).alias("positions"))


def simple_search(index: DataFrame, terms: list[str], mode: str = "and") -> DataFrame:
    """(doc_id) with all or any of the lower-cased terms."""
    mode = checks.one_of("mode", mode, ("and", "or"))
    wanted = sorted({t.lower() for t in terms})
    hit = index.filter(F.col("term").isin(*wanted)).select("term", F.explode("doc_ids").alias("doc_id"))
    need = len(wanted) if mode == "and" else 1
    return hit.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") >= need).select("doc_id")
