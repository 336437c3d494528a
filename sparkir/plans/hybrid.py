"""Planned hybrid retrieval: each query goes to the retrievers that its plan enables, and the lists are fused."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.operators.ranking import rrf
from sparkir.plans.planning import MODES, plan
from sparkir.session import stage

#: (queries (query_id, text), candidate_k) -> (query_id, document_id, score, rank)
Retriever = Callable[[DataFrame, int], DataFrame]


class FusionStrategy(ABC):
    @abstractmethod
    def fuse(self, lists: DataFrame, top_k: int) -> DataFrame:
        """(query_id, document_id, score, rank) out of lists (query_id, list, document_id, rank)."""


class ReciprocalRankFusion(FusionStrategy):
    def __init__(self, k: int = 60):
        self.k = checks.whole("k", k)

    def fuse(self, lists: DataFrame, top_k: int) -> DataFrame:
        return rrf(lists, top_k, self.k)


class HybridRetriever:
    """retrievers: a retriever per mode, some or all of lexical, dense and graph."""

    def __init__(self, retrievers: dict[str, Retriever], fusion: FusionStrategy | None = None, candidate_multiplier: int = 5, planner=plan):
        if not retrievers or not set(retrievers) <= set(MODES):
            raise ValueError(f"retrievers must be some of {', '.join(MODES)}")
        for r in retrievers.values():
            if not callable(r):
                raise TypeError("a retriever must be callable")
        self.retrievers, self.fusion = dict(retrievers), fusion or ReciprocalRankFusion()
        self.multiplier, self.planner = checks.whole("candidate_multiplier", candidate_multiplier), planner

    def lists(self, queries: DataFrame, top_k: int = 10) -> DataFrame | None:
        """(query_id, list, list_at, document_id, rank) of every retriever that a query's plan enables and that there is, with
        metadata (null where a retriever gives none) if any of them gives it. list_at is the retriever's place."""
        planned = self.planner(queries, top_k, self.multiplier).select("query_id", "text", "enabled_modes")
        out = None
        for at, (mode, retrieve) in enumerate(self.retrievers.items()):
            asked = planned.filter(F.array_contains("enabled_modes", mode)).select("query_id", "text")
            part = retrieve(asked, max(top_k, top_k * self.multiplier))
            carried = ["metadata"] if "metadata" in part.columns else []
            part = stage(part, mode)  # a few rows per query, and what ranked them is freed
            part = part.select("query_id", F.lit(mode).alias("list"), F.lit(at).alias("list_at"), F.col("document_id").cast("string").alias("document_id"), "rank", *carried)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def retrieve(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, document_id, score, rank); a query none of whose modes has a retriever gives no rows."""
        checks.whole("top_k", top_k)
        return self.fusion.fuse(self.lists(queries, top_k), top_k)

    __call__ = retrieve
