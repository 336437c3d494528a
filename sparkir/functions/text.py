"""Text analysis as column expressions: tokenize, lower-case, drop stop words, stem or lemmatize."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkir.functions.porter import stem

# The twenty stop words.
STOPWORDS = ("the", "is", "in", "and", "to", "a", "of", "that", "it", "on", "for", "with", "as", "was", "at", "by", "an", "be", "this", "which")

#: Word characters. Java's \w is ASCII only, and (?U)\w takes combining marks but not all numerals.
W = r"[\p{L}\p{N}_]"

Tokenizer = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def regex_tokens(c: Column | str) -> Column:
    """Maximal runs of letters, numerals and underscores; an empty array for null."""
    return _array(F.regexp_extract_all(_col(c), F.lit(f"{W}+"), F.lit(0)))


def whitespace_tokens(c: Column | str) -> Column:
    """Runs of anything but white space, Unicode white space included; an empty array for null."""
    return _array(F.regexp_extract_all(_col(c), F.lit(r"[^\s\p{Z}\x1c-\x1f\x85]+"), F.lit(0)))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def without_stopwords(tokens: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


def hyphen_tokens(c: Column | str) -> Column:
    """Words in which hyphens join; each begins and ends with a word character."""
    return _array(F.regexp_extract_all(_col(c), F.lit(f"{W}(?:(?:{W}|-)*{W})?"), F.lit(0)))


def ascii_tokens(c: Column | str) -> Column:
    """The distinct lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(_array(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))))


def _of_each_distinct(tokens: pa.Array, change: Callable[[str], str | None]) -> pa.Array:
    """An Arrow list array of words with ``change`` called once per different word of the batch."""
    flat = tokens.flatten().dictionary_encode()
    words = pa.array([None if w is None else change(w) for w in flat.dictionary.to_pylist()], pa.string())
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, words.take(flat.indices), mask=tokens.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The Porter stems of an array of tokens; each different word is stemmed once per Arrow batch."""
    for tokens in parts:
        yield _of_each_distinct(tokens, stem)


def lemmas_of(lemmas: dict[str, str]) -> Callable[[Column], Column]:
    """A column function from an array of tokens to that of their lemmas, by a dictionary that fits in a worker; a word that it
    lacks stays. Larger dictionaries are tables: `lemmatized`."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in parts:
            yield _of_each_distinct(tokens, lambda w: lemmas.get(w, w))

    return run


@F.pandas_udf(T.StringType())
def stem_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(stem, na_action="ignore")


def spacy_tokens(model: str = "en_core_web_sm"):
    """A tokenizer backed by spaCy, where that and its model are installed; RuntimeError otherwise."""
    try:
        import spacy  # noqa: F401
    except ImportError as e:
        raise RuntimeError("spaCy is not installed") from e

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import spacy

        nlp = spacy.load(model)
        for s in parts:
            yield pd.Series([[t.text for t in d] for d in nlp.pipe(s.fillna("").tolist())], index=s.index)

    return lambda c: run(_col(c))


class Analyzer:
    """tokenize -> lower-case -> drop stop words -> stem or lemmatize; a Column in, an array column out.

    Stop words go before stemming. With stem=False and without lemmas everything stays in the JVM. lemmas: a dictionary, used
    where stem is False, as none is built in.
    """

    def __init__(self, tokenizer: Tokenizer = regex_tokens, lowercase: bool = True, stopwords: tuple[str, ...] = STOPWORDS, stem: bool = True, lemmas: dict[str, str] | None = None):
        if not callable(tokenizer):
            raise TypeError("tokenizer must be callable")
        self.tokenizer, self.lowercase, self.stopwords, self.stem, self.lemmas = tokenizer, lowercase, tuple(stopwords), stem, lemmas

    def __call__(self, c: Column | str) -> Column:
        t = self.tokenizer(_col(c))
        t = lowered(t) if self.lowercase else t
        t = without_stopwords(t, self.stopwords)
        return stemmed(t) if self.stem else lemmas_of(self.lemmas)(t) if self.lemmas else t


def lemmatized(tokens: DataFrame, lemmas: DataFrame, term: str = "term") -> DataFrame:
    """tokens with ``term`` replaced by its lemma, where lemmas (term, lemma) has one; of several the least counts."""
    one = lemmas.filter("term IS NOT NULL AND lemma IS NOT NULL").groupBy(F.col("term").alias("__t")).agg(F.min("lemma").alias("__l"))
    joined = tokens.join(one, tokens[term] == F.col("__t"), "left")
    return joined.withColumn(term, F.coalesce("__l", term)).drop("__t", "__l")
