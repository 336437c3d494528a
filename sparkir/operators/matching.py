"""Boolean, phrase, prefix, wildcard, fuzzy and synonym queries, query expansion and candidates, over index tables."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions import checks
from sparkir.functions.text import Analyzer
from sparkir.operators import blocks


def check_queries(queries: DataFrame) -> DataFrame:
    """queries, after a check that every text is there and not blank (ValueError naming one that is not)."""
    checks.none_left(queries.filter("text IS NULL OR trim(text) = ''"), "a query must have a text")
    return queries


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query_id, ord, term): analyzed like documents; repeated terms stay, blank queries give no row."""
    return queries.select("query_id", F.posexplode(analyzer("text")).alias("ord", "term"))


def expand_terms(terms: DataFrame, expansions: DataFrame) -> DataFrame:
    """(query_id, ord, term): every term followed by the terms that expansions (term, ord, related) adds, each once.

    One level deep; of repeated terms the first place counts, and ord is renumbered from 0.
    """
    own = terms.select("query_id", F.col("ord").alias("a"), F.lit(-1).alias("b"), "term")
    more = terms.select("query_id", F.col("ord").alias("a"), "term").join(expansions.select("term", F.col("ord").alias("b"), "related"), "term")
    every = own.unionByName(more.select("query_id", "a", "b", F.col("related").alias("term")))
    first = every.groupBy("query_id", "term").agg(F.min(F.struct("a", "b")).alias("at"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "term")) - 1
    return first.select("query_id", order.alias("ord"), "term")


class BooleanQuery(ABC):
    """A node of a query tree; evaluate gives (doc_id), distinct."""

    @abstractmethod
    def evaluate(self, posts: DataFrame) -> DataFrame: ...

    def __and__(self, other: BooleanQuery) -> BooleanQuery:
        return And(self, other)

    def __or__(self, other: BooleanQuery) -> BooleanQuery:
        return Or(self, other)


def _query(x: object) -> BooleanQuery:
    if not isinstance(x, BooleanQuery):
        raise TypeError("operands must be queries")
    return x


@dataclass
class Term(BooleanQuery):
    """Documents that have exactly this term; it is not analyzed."""

    term: str

    def __post_init__(self):
        checks.text("term", self.term)

    def evaluate(self, posts):
        return posts.filter(F.col("term") == self.term).select("doc_id").distinct()


@dataclass
class And(BooleanQuery):
    left: BooleanQuery
    right: BooleanQuery

    def __post_init__(self):
        _query(self.left), _query(self.right)

    def evaluate(self, posts):
        return self.left.evaluate(posts).join(self.right.evaluate(posts), "doc_id", "left_semi")


@dataclass
class Or(BooleanQuery):
    left: BooleanQuery
    right: BooleanQuery

    def __post_init__(self):
        _query(self.left), _query(self.right)

    def evaluate(self, posts):
        return self.left.evaluate(posts).union(self.right.evaluate(posts)).distinct()


@dataclass
class Not(BooleanQuery):
    """The documents of ``universe`` (doc_id) that the query does not match; it may hold ids that are not indexed."""

    query: BooleanQuery
    universe: DataFrame

    def __post_init__(self):
        _query(self.query)

    def evaluate(self, posts):
        return self.universe.select("doc_id").distinct().join(self.query.evaluate(posts), "doc_id", "left_anti")


class _Vocabulary(BooleanQuery):
    """Documents with any term that `predicate` accepts. The predicate is a filter on postings, so it reaches the scan."""

    def predicate(self) -> Column:
        raise NotImplementedError

    def matching_terms(self, vocab: DataFrame) -> DataFrame:
        return vocab.select("term").distinct().filter(self.predicate())

    def evaluate(self, posts):
        return posts.filter(self.predicate()).select("doc_id").distinct()


@dataclass
class Prefix(_Vocabulary):
    prefix: str

    def __post_init__(self):
        checks.text("prefix", self.prefix)

    def predicate(self):
        return F.col("term").startswith(self.prefix)


def wildcard_pattern(pattern: str) -> str:
    """A Java pattern for the whole term: * is any run, ? any one character, neither a line break; the rest is literal."""
    quoted = lambda s: re.sub(r"([\\.\[\]{}()<>*+\-=!?^$|#&~])", r"\\\1", s)
    return "^" + "".join(".*" if p == "*" else "." if p == "?" else quoted(p) for p in re.split(r"([*?])", pattern)) + "$"


@dataclass
class Wildcard(_Vocabulary):
    pattern: str

    def __post_init__(self):
        checks.text("pattern", self.pattern)

    def predicate(self):
        start = re.match(r"[^*?]*", self.pattern)[0]
        whole = F.col("term").rlike(wildcard_pattern(self.pattern))
        return F.col("term").startswith(start) & whole if start else whole  # the literal start can be pushed down


@dataclass
class Fuzzy(_Vocabulary):
    """Terms within ``max_distance`` insertions, deletions and replacements."""

    term: str
    max_distance: int = 1

    def __post_init__(self):
        checks.text("term", self.term)
        checks.whole("max_distance", self.max_distance, 0)

    def predicate(self):
        near = F.abs(F.length("term") - len(self.term)) <= self.max_distance
        return near & (F.levenshtein("term", F.lit(self.term), self.max_distance) >= 0)


@dataclass
class Synonyms(_Vocabulary):
    """The term or any of its synonyms."""

    term: str
    synonyms: dict[str, list[str]]

    def __post_init__(self):
        checks.text("term", self.term)
        if not isinstance(self.synonyms, dict):
            raise TypeError("synonyms must be a dictionary")

    def predicate(self):
        return F.col("term").isin(*dict.fromkeys([self.term, *self.synonyms.get(self.term, [])]))


@dataclass
class Phrase(BooleanQuery):
    """Documents with the terms in this order and side by side; evaluate takes tokens (doc_id, pos, term)."""

    terms: list[str]

    def __post_init__(self):
        if not isinstance(self.terms, (list, tuple)):
            raise TypeError("terms must be a list")
        if not self.terms:
            raise ValueError("terms must not be empty")
        for t in self.terms:
            checks.text("term", t)

    def evaluate(self, toks):
        wanted = reduce(lambda m, it: m | {it[1]: [*m.get(it[1], []), it[0]]}, enumerate(self.terms), {})
        at = F.coalesce(*[F.when(F.col("term") == t, F.array(*map(F.lit, places))) for t, places in wanted.items()])
        hits = toks.filter(F.col("term").isin(*wanted)).select("doc_id", "pos", F.explode(at).alias("i"))
        return hits.groupBy("doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(self.terms)).select("doc_id").distinct()


def phrase_matches(phrases: DataFrame, toks: DataFrame) -> DataFrame:
    """(query_id, doc_id) for a batch of phrases (query_id, ord, term): one join and one aggregation by start."""
    sizes = phrases.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = phrases.join(toks, "term").groupBy("query_id", "doc_id", (F.col("pos") - F.col("ord")).alias("start")).agg(F.count("*").alias("hit"))
    return hits.join(sizes, "query_id").filter("hit = n").select("query_id", "doc_id").distinct()


def phrase_documents(phrases: DataFrame, documents: DataFrame, analyzer: Analyzer) -> DataFrame:
    """`phrase_matches` over documents (doc_id, text) of unique ids: every document meets all phrases where it is read."""
    if not blocks.can_pack(documents):
        return phrase_matches(phrases, documents.select("doc_id", F.posexplode(analyzer("text")).alias("pos", "term")))
    return blocks.phrases_in(phrases, documents.select("doc_id", analyzer("text").alias("terms")))


def fuzzy_matches(terms: DataFrame, vocab: DataFrame, max_distance: int = 1, q: int = 2) -> DataFrame:
    """(query_id, term, match) for a batch of terms (query_id, term): the vocabulary within max_distance edits.

    No cross join: words at most d edits apart share a deletion neighbour, i.e. the same word after removing up to d
    characters on either side, for d <= 2; so both sides are keyed by those and equi-joined, then verified.
    """
    d = checks.whole("max_distance", max_distance, 0)
    if d > 2:
        raise ValueError("batches go up to two edits; use Fuzzy for one term at a time")

    def shorter(words: Column) -> Column:
        one = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        return F.array_distinct(F.concat(words, one))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        k = F.array(F.col(name))
        for _ in range(d):
            k = shorter(k)
        return df.select("*", F.explode(k).alias("__key"))

    left = keyed(terms.select("query_id", "term").distinct(), "term")
    right = keyed(vocab.select(F.col("term").alias("match")).distinct(), "match")
    return left.join(right, "__key").filter(F.levenshtein("term", "match", d) >= 0).select("query_id", "term", "match").distinct()


def candidates(terms: DataFrame, posts: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id): documents with any of a query's terms; blank and unknown terms match nothing. packed: the postings
    as an index keeps them, where it does; the queries go to them then."""
    t = terms.select("query_id", F.trim("term").alias("term")).filter("term <> ''").distinct()
    if blocks.can_pack(packed):
        return blocks.every_hit(t, packed)
    return t.join(posts.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()
