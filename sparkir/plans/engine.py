"""The facade: a corpus with its index, graph and vectors, and batches of queries against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.functions import checks, providers
from sparkir.functions.text import Analyzer
from sparkir.operators import graph as G
from sparkir.operators.dense import DenseRetriever
from sparkir.operators.index import Index, build_index
from sparkir.operators.lexical import search
from sparkir.operators.ranking import cross_rerank
from sparkir.plans import rag
from sparkir.plans.hybrid import FusionStrategy, HybridRetriever
from sparkir.plans.planning import plan


class RetrievalFailure(RuntimeError):
    """A query's plan needs a retriever that is not configured, or retrieval failed."""


class GenerationFailure(RuntimeError):
    """No reranker or generator is configured, or generation failed."""


class SearchEngine:
    """search answers by words alone; retrieve follows the plan of each query; answer adds reranking and generation.

    embed is a column function for texts, score one for (query, text), generate one for (query, context); what is left out
    is not configured.
    """

    def __init__(self, documents: DataFrame, analyzer: Analyzer | None = None, embed=None, score=None, generate=None, graph: bool = True,
                 fusion: FusionStrategy | None = None, index: Index | None = None, max_characters: int | None = None):
        self.documents = documents
        self.index = index or build_index(documents, analyzer)
        self.dense = DenseRetriever.from_documents(documents, embed) if embed is not None else None
        self.nodes, self.edges = G.build_graph(documents) if graph and "metadata" in documents.columns else (None, None)
        self.score, self.generate, self.max_characters = score, generate, max_characters
        retrievers = {"lexical": self._lexical}
        if self.dense is not None:
            retrievers["dense"] = lambda q, k: self.dense.retrieve(q, k)
        if self.nodes is not None:
            retrievers["graph"] = lambda q, k: G.graph_retrieve(q, self.nodes, self.edges, k)
        self.hybrid = HybridRetriever(retrievers, fusion)

    def _lexical(self, queries: DataFrame, k: int) -> DataFrame:
        return search(queries, self.index, "OR", k).withColumnRenamed("doc_id", "document_id")

    def capabilities(self) -> dict[str, bool]:
        have = self.hybrid.retrievers
        return {"lexical": True, "dense": "dense" in have, "graph": "graph" in have, "hybrid": len(have) > 1, "reranking": self.score is not None, "generation": self.generate is not None}

    def search(self, queries: DataFrame, mode: str = "OR", top_k: int = 10) -> DataFrame:
        return search(queries, self.index, mode, top_k)

    __call__ = search

    def retrieve(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, document_id, score, rank). RetrievalFailure if any query's plan needs a mode that is not configured."""
        checks.whole("top_k", top_k)
        needed = plan(queries, top_k).select(F.explode("enabled_modes").alias("mode")).distinct().collect()  # three at most
        missing = {r.mode for r in needed} - set(self.hybrid.retrievers)
        if missing:
            raise RetrievalFailure(f"not configured: {', '.join(sorted(missing))}")
        return self.hybrid.retrieve(queries, top_k)

    def rerank(self, queries: DataFrame, results: DataFrame, top_k: int = 10) -> DataFrame:
        if self.score is None:
            raise GenerationFailure("no reranker is configured")
        return cross_rerank(results, queries, self.documents, self.score, top_k)

    def answer(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, answer, document_ids) of every query; a null answer where nothing was retrieved."""
        if self.score is None or self.generate is None:
            raise GenerationFailure("a reranker and a generator are needed")
        found = self.rerank(queries, self.retrieve(queries, top_k), top_k)
        contexts = rag.context(rag.evidence(found, self.documents), self.max_characters)
        return rag.answers(queries, contexts, self.generate)


def create_search_engine(documents: DataFrame, configure_optional: bool = False, **kw) -> SearchEngine:
    """An engine with every optional part that is installed here; parts that are not stay unconfigured."""
    if configure_optional:
        have = providers.available()
        if have["sentence_transformers"]:
            kw.setdefault("embed", providers.embed_column(providers.SentenceTransformerEmbedding))
            kw.setdefault("score", providers.cross_encode_column(providers.SentenceTransformerCrossEncoder))
        if have["ollama"]:
            kw.setdefault("generate", providers.generate_column(providers.OllamaGenerator))
    return SearchEngine(documents, **kw)
