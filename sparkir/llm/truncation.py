"""Texts cut off by field limits (problem 10).

A text is read from its end: closing lines (sign-off, tags, list, reference, feed name) are set aside, then whatever an
exporter put behind the cut. What is left, the running text, must end in a finished sentence, and a stack automaton over
the whole of it must find nothing that it opened still open. Lines and marks are told by their build, not by words of some
language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.operators.skew import salted_join
from sparkir.session import stage

#: Lines of their own that may follow a finished text: dashes, bullets, tags, numbers in brackets, or a label of one or two
#: words with a colon and a short value without a sentence in it.
CLOSING = re.compile(r"\s*(?:(?:--|—|–)\s*\S.*|[-*•]\s+\S.*|\#\w.*|\[\d+\].*|[^\W\d_]+(?: [^\W\d_]+)?\s*:(?:\s+[^\s.!?]+(?:\.[^\s.!?]+)*){1,12})\s*")
#: One or two words, a comma, and nothing but a name: a sign-off.
SIGNED = re.compile(r"\s*[^\W\d_]+(?: [^\W\d_]+)?,((?:\s+[^\W\d_][\w.'’-]*){1,5})\s*")
#: What exporters put behind a cut: dots, or up to three words in brackets.
MARK = re.compile(r"\s*(?:\.\.+|…|[\[(<]\s*(?:\.\.+|…|[^\W\d_]+(?:\s[^\W\d_]+){0,2}(?:\.\.+|…)?)\s*[\])>])\s*$")
#: The beginning of an entity, a backslash or percent escape, or a tag.
ESCAPE = re.compile(r"(?:&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9a-fA-F]|</?[a-zA-Z][^<>]*|</?)$")
FINISHED = re.compile(r"[.!?。！？؟।](?:[\"'”’»)\]}*_]|</\w+>)*$")
NESTING = re.compile(r"[()\[\]{}\"“”„«»]|</?[a-zA-Z][^<>]*>")
CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def _closes(text: str, start: int, end: int) -> bool:
    if CLOSING.fullmatch(text, start, end):
        return True
    m = SIGNED.fullmatch(text, start, end)
    return bool(m) and all(w[0].isupper() for w in m[1].split())


def running_text(text: str) -> str:
    """The text without its closing lines and the white space around them."""
    end = len(text)
    while True:
        while end and text[end - 1].isspace():
            end -= 1
        start = text.rfind("\n", 0, end) + 1
        if not end or not _closes(text, start, end) or (start == 0 and not text[start].isspace() and text[start] not in "-—–#["):
            return text[:end]
        end = start


def still_open(text: str) -> int:
    """How many brackets, quotes and tags of the text are opened and not closed: a stack automaton, run once over all of it."""
    stack: list[str] = []
    for m in NESTING.finditer(text):
        t = m[0]
        if t[0] == "<":
            name = "<" + re.match(r"</?(\w+)", t)[1].lower()
            if t.startswith("</"):
                if name in stack:  # closes whatever was left open inside
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not t.endswith("/>") and name not in ("<br", "<hr", "<img"):
                stack.append(name)
        elif t == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(t)
        elif t == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif t in CLOSES:
            if stack and stack[-1] == CLOSES[t]:
                stack.pop()
        else:
            stack.append(t)
    return len(stack)


def examine(text: str | None) -> str | None:
    """The evidence that a text is cut: mark, bytes, escape, open or unfinished; whole, blank, or None for null.

    A text of closing lines only is whole."""
    if text is None:
        return None
    if not text.strip():
        return "blank"
    body = running_text(text)
    if not body:
        return "whole"
    if body[-1] == "�" or "\ud800" <= body[-1] <= "\udfff" or body[-1] == "\x00":
        return "bytes"
    if MARK.search(body):
        return "mark"
    if FINISHED.search(body):
        return "open" if still_open(body) else "whole"
    return "escape" if ESCAPE.search(body) else "unfinished"


def normal_source(c: Column | str) -> Column:
    """Sources compare trimmed and lower-cased; null stays null."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def examined(documents: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", baseline_share: float = 0.8,
             usual: float = 0.1, weight: float = 10.0, exempt: bool = True) -> DataFrame:
    """The rows of ``documents``, without the text, with normal_source, evidence and cut (boolean; null for null and blank
    texts).

    With ``exempt`` false every text is judged by itself, as TESTDATA.md defines a case, and a source whose field limit cuts
    all its texts shows them all; the registered queries do so. Otherwise what a source does with most of its texts is no
    evidence there: a missing terminator counts unless the share of its texts that are unfinished without any other evidence
    reaches ``baseline_share``, and something left open unless that of its finished texts with something open does. Shares
    are drawn to ``usual`` as if ``weight`` further texts had it, so they grow steadily with the texts and no number of
    texts is a switch. That is for collections of titles and the like: it cannot tell them from a source that is cut
    everywhere. Texts without source share a baseline. Whole texts are read once, in Arrow batches, and what was seen is
    kept without them; the join of the baselines is salted for hot sources.
    """

    @F.pandas_udf("string")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(examine, na_action="ignore")

    seen = documents.withColumn("normal_source", F.coalesce(normal_source(source), F.lit(""))).withColumn("evidence", evidence(text))
    seen = stage(seen.drop(text), "examined")
    if not exempt:
        return seen.withColumn("cut", F.when(F.col("evidence") != "blank", F.col("evidence") != "whole"))
    count = lambda *kinds: F.sum(F.when(F.col("evidence").isin(*kinds), 1.0).otherwise(0.0))
    share = lambda part, whole: (part + usual * weight) / (whole + weight) >= baseline_share
    every = count("whole", "mark", "bytes", "escape", "open", "unfinished")
    habits = seen.groupBy("normal_source").agg(share(count("unfinished"), every).alias("__loose"), share(count("open"), count("open", "whole")).alias("__open"))
    joined = salted_join(seen, habits, ["normal_source"], F.col(row_id), "left")
    cut = F.col("evidence").isin("mark", "bytes", "escape") | ((F.col("evidence") == "unfinished") & ~F.col("__loose")) | ((F.col("evidence") == "open") & ~F.col("__open"))
    return joined.withColumn("cut", F.when(F.col("evidence").isNull() | (F.col("evidence") == "blank"), F.lit(None)).otherwise(cut)).drop("__loose", "__open")


def cut_rates(found: DataFrame) -> DataFrame:
    """(source, texts, cut, rate, and one count per kind of evidence) per normal source; null and blank texts count for
    nothing, a source without texts has no row."""
    kinds = [F.sum(F.when(F.col("cut") & (F.col("evidence") == k), 1).otherwise(0)).alias(k) for k in ("mark", "bytes", "escape", "open", "unfinished")]
    return found.filter("cut IS NOT NULL").groupBy(F.col("normal_source").alias("source")).agg(
        F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("rate"), *kinds)
