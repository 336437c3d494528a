"""Pluggable models: embeddings, cross-encoders and generators.

A model is a Python object that is made once per Python worker by a factory, so that it needs no pickling, and gets Arrow
batches. None of the model libraries is required; the wrappers for them raise RuntimeError where they are missing.
"""

from __future__ import annotations

import json
import math
import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from urllib import error as url_error
from urllib import request

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkir.functions import checks


def _vector(v: Sequence[float]) -> list[float]:
    out = [float(x) for x in v]
    if not out or not all(map(math.isfinite, out)):
        raise ValueError("an embedding must be a non-empty list of finite numbers")
    return out


class EmbeddingModel(ABC):
    """Texts in, vectors out. Subclasses implement embed_many for stripped, non-blank texts."""

    @abstractmethod
    def embed_many(self, texts: list[str]) -> list[Sequence[float]]: ...

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        clean = [checks.text("text", t).strip() for t in texts]
        out = [_vector(v) for v in self.embed_many(clean)] if clean else []
        if len(out) != len(clean) or len({len(v) for v in out}) > 1:
            raise ValueError("the model must give one vector per text, all of one dimension")
        return out


class SentenceTransformerEmbedding(EmbeddingModel):
    def __init__(self, model: str = "all-MiniLM-L6-v2"):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("sentence_transformers is not installed") from e
        self.model = SentenceTransformer(checks.text("model", model))

    def embed_many(self, texts):
        return self.model.encode(texts).tolist()


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    r = request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with request.urlopen(r, timeout=timeout) as f:
            return json.loads(f.read())
    except TimeoutError as e:
        raise TimeoutError(f"{url} did not answer in {timeout} s") from e
    except (url_error.URLError, ValueError) as e:
        if isinstance(getattr(e, "reason", None), TimeoutError):
            raise TimeoutError(f"{url} did not answer in {timeout} s") from e
        raise RuntimeError(f"{url}: {e}") from e


class OllamaEmbedding(EmbeddingModel):
    def __init__(self, model: str = "all-minilm", host: str | None = None, timeout: float = 60.0):
        self.model, self.timeout = checks.text("model", model), timeout
        self.host = host or os.getenv("OLLAMA_HOST") or "http://localhost:11434"
        self.dimension: int | None = None

    def embed_many(self, texts):
        out = _post(f"{self.host}/api/embed", {"model": self.model, "input": texts}, {}, self.timeout).get("embeddings")
        if not isinstance(out, list):
            raise RuntimeError("the provider gave no embeddings")
        for v in out:  # the first answer fixes the dimension
            self.dimension = self.dimension or len(v)
            if len(v) != self.dimension:
                raise ValueError(f"expected {self.dimension} dimensions, got {len(v)}")
        return out


class OpenAIEmbedding(EmbeddingModel):
    def __init__(self, model: str = "text-embedding-3-small", key: str | None = None, dimensions: int | None = None, url: str = "https://api.openai.com/v1/embeddings", timeout: float = 60.0):
        self.model, self.dimensions, self.url, self.timeout = checks.text("model", model), dimensions, url, timeout
        self.key = key or os.getenv("OPENAI_API_KEY")
        if not self.key:
            raise RuntimeError("OPENAI_API_KEY is not set")

    def embed_many(self, texts):
        body = {"model": self.model, "input": texts} | ({"dimensions": self.dimensions} if self.dimensions else {})
        data = _post(self.url, body, {"Authorization": f"Bearer {self.key}"}, self.timeout).get("data")
        if not isinstance(data, list) or len(data) != len(texts):
            raise RuntimeError("the provider gave another number of embeddings")
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


class CrossEncoder(ABC):
    """(query, text) pairs in, finite scores out."""

    @abstractmethod
    def score_many(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def score(self, query: str, text: str) -> float:
        return self.score_batch(query, [text])[0]

    def score_batch(self, query: str, texts: list[str]) -> list[float]:
        return self.scores([(query, t) for t in texts])

    def scores(self, pairs: list[tuple[str, str]]) -> list[float]:
        for q, t in pairs:
            checks.text("query", q)
            checks.text("document text", t)
        out = [float(s) for s in self.score_many(pairs)] if pairs else []
        if len(out) != len(pairs) or not all(map(math.isfinite, out)):
            raise ValueError("the model must give one finite score per pair")
        return out


class CountingCrossEncoder(CrossEncoder):
    """How often the lower-cased query occurs in the lower-cased text; deterministic, for tests and queries without a model."""

    def score_many(self, pairs):
        return [float(t.lower().count(q.lower())) for q, t in pairs]


class SentenceTransformerCrossEncoder(CrossEncoder):
    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
        try:
            from sentence_transformers import CrossEncoder as Model
        except ImportError as e:
            raise RuntimeError("sentence_transformers is not installed") from e
        self.model = Model(checks.text("model", model))

    def score_many(self, pairs):
        return self.model.predict(pairs).tolist()


class Generator(ABC):
    """A context in, an answer out."""

    @abstractmethod
    def generate(self, query: str, context: str) -> str: ...

    def __call__(self, query: str, context: str) -> str:
        return self.generate(query, context)


# The parts of the grounded prompt.
PROMPT_HEAD = (
    "Answer the query using only the supplied evidence. Do not use outside knowledge. "
    "If the evidence does not support an answer, say that the evidence is insufficient."
)
PROMPT = PROMPT_HEAD + "\n\nQuery: {query}\n\nEvidence:\n{context}\n\nAnswer:"


class OllamaGenerator(Generator):
    def __init__(self, model: str | None = None, host: str | None = None, timeout: float = 120.0):
        self.model = checks.text("model", model or os.getenv("OLLAMA_MODEL") or "")
        self.host, self.timeout = host or os.getenv("OLLAMA_HOST") or "http://localhost:11434", timeout

    def generate(self, query, context):
        checks.text("query", query)
        checks.text("context", context)
        out = _post(f"{self.host}/api/generate", {"model": self.model, "prompt": PROMPT.format(query=query, context=context), "stream": False}, {}, self.timeout).get("response")
        if not isinstance(out, str) or not out.strip():
            raise RuntimeError("the provider gave no answer")
        return out.strip()


def embed_column(make: Callable[[], EmbeddingModel]):
    """A function of one text column that gives array<double>; null and blank texts raise."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            yield pd.Series(model.embed_batch(s.tolist()), index=s.index, dtype=object)

    return lambda c: run(c)


def cross_encode_column(make: Callable[[], CrossEncoder]):
    """A function of two columns (query, text) that gives a double; null and blank values raise."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            yield pd.Series(model.scores(list(zip(q, t))), index=q.index, dtype="float64")

    return lambda q, t: run(q, t)


def generate_column(make: Callable[[], Generator]):
    """A function of two columns (query, context) that gives the answer; null for a null or empty context."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, c in parts:
            yield pd.Series([model.generate(x, y) if isinstance(y, str) and y else None for x, y in zip(q, c)], index=q.index, dtype=object)

    return lambda q, c: run(q, c)


def prompt(query: Column, context: Column) -> Column:
    """The grounded prompt as a column."""
    return F.concat(F.lit(PROMPT_HEAD + "\n\nQuery: "), query, F.lit("\n\nEvidence:\n"), context, F.lit("\n\nAnswer:"))


def available() -> dict[str, bool]:
    """Which optional model libraries and services are configured here."""
    from importlib.util import find_spec

    found = {m: find_spec(m) is not None for m in ("sentence_transformers", "spacy", "nltk")}
    return found | {"ollama": bool(os.getenv("OLLAMA_MODEL")), "openai": bool(os.getenv("OPENAI_API_KEY"))}
