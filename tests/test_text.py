import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkir.functions import text as X
from sparkir.functions.porter import stem


def tokens(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.t for r in df.select("i", f("text").alias("t")).orderBy("i").collect()]


def test_tokenizers(spark):
    texts = ["The Machine!", "a_b c-d é1", "", None, "  x y z ", "it's ½²"]
    assert tokens(spark, X.regex_tokens, texts) == [["The", "Machine"], ["a_b", "c", "d", "é1"], [], [], ["x", "y", "z"], ["it", "s", "½²"]]
    assert tokens(spark, X.whitespace_tokens, texts) == [["The", "Machine!"], ["a_b", "c-d", "é1"], [], [], ["x", "y", "z"], ["it's", "½²"]]
    assert tokens(spark, X.hyphen_tokens, ["state-of-the-art -x- y--z", None]) == [["state-of-the-art", "x", "y--z"], []]
    assert tokens(spark, X.ascii_tokens, ["A a B-1 é", None]) == [["a", "b", "1"], []]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abXY _-.,1é\n\t", max_size=30), min_size=20, max_size=20))
def test_tokenizers_agree_with_python(spark, texts):
    assert tokens(spark, X.regex_tokens, texts) == [re.findall(r"\w+", t) for t in texts]
    assert tokens(spark, X.whitespace_tokens, texts) == [t.split() for t in texts]
    assert tokens(spark, X.hyphen_tokens, texts) == [re.findall(r"\b[\w-]+\b", t) for t in texts]


def test_analyzer(spark):
    assert tokens(spark, X.Analyzer(), ["The Machine!", "is the", None]) == [["machin"], [], []]
    assert tokens(spark, X.Analyzer(stem=False), ["The Machine is Learning"]) == [["machine", "learning"]]
    with pytest.raises(TypeError):
        X.Analyzer(tokenizer="x")
    with pytest.raises(RuntimeError):
        X.spacy_tokens()


def test_stems():
    words = "caresses ponies cats feed agreed plastered motoring conflated hopping falling filing happy relational digitizer hopeful revival adjustment adoption controll sky dying flies"
    want = "caress poni cat feed agre plaster motor conflat hop fall file happi relat digit hope reviv adjust adopt control sky die fli"
    assert [stem(w) for w in words.split()] == want.split()
    assert stem("at") == "at" and stem("Machines") == "machin"


def test_lemmas(spark, rows):
    t = spark.createDataFrame([(1, "mice"), (1, "run"), (1, None)], "doc_id long, term string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("mice", "mus"), (None, "x")], "term string, lemma string")
    assert rows(X.lemmatized(t, lemmas)) == [(1, "mouse"), (1, "run"), (1, None)]
    assert t.select(F.sum(X.stem_of("term").isNotNull().cast("int"))).first()[0] == 2


def test_lemmatizing_analyzer(spark):
    from sparkir.functions.text import Analyzer

    df = spark.createDataFrame([("Mice ran, the mouse runs",), (None,), ("",)], "t string")
    a = Analyzer(stem=False, lemmas={"mice": "mouse", "ran": "run", "runs": "run"})
    assert [r[0] for r in df.select(a("t")).collect()][0] == ["mouse", "run", "mouse", "run"]
    stems = [r[0] for r in df.select(Analyzer()("t")).collect()]
    assert stems[0] == ["mice", "ran", "mous", "run"] and not stems[1] and stems[2] == []
