import pytest

from sparkir.llm import truncation as T


@pytest.mark.parametrize("text, evidence", [
    (None, None), ("", "blank"), (" \n\t", "blank"), ("All is well.", "whole"), ("Is it? Yes!", "whole"), ('He said "yes."', "whole"), ("It is (see A-1).", "whole"),
    ("All is well.\n-- some feed", "whole"), ("All is well.\n\nSigned, A. Person\n#a #b", "whole"), ("All is well.\nSee:\n", "unfinished"), ("All is well.\n- one\n- two", "whole"),
    ("All is well.\n— A Person", "whole"), ("All is well.\nRef: RQ-1", "whole"), ("All is we", "unfinished"), ("All is well. It", "unfinished"), ("All is we\n-- some feed", "unfinished"),
    ("All is we...", "mark"), ("All is we…", "mark"), ("All is we [...]", "mark"), ("All is we [more]\nRef: RQ-2", "mark"), ("All is we�", "bytes"), ("All is we &quo", "escape"),
    ("All is we &#3", "escape"), ("All is we \\u00", "escape"), ("All is we %2", "escape"), ("All is we </di", "escape"), ("All is 50", "unfinished"), ("All is we,", "unfinished"), ('The "word is here.', "open"), ("One (two. Three four.", "open"), ("Nested (one [two]. Done.", "open"), ("Nested (one [two]). Done.", "whole"), ("<b>bold <i>both</b> end.", "whole"), ("<div>It <b>is.", "open"), ("It was (done.", "open"),
    ("<p>All is well.</p>", "whole"), ("<p>All is well.", "open"), ("- only\n- lines", "whole"), ("x" * 200_000 + ".", "whole"), ("a. " * 100_000 + "b", "unfinished"), ("(" * 1000 + "a.", "open"),
])
def test_examine(text, evidence):
    assert T.examine(text) == evidence


def test_every_cut_of_a_whole_text_inside_a_sentence_is_found():
    text = 'Dense retrieval (see RQ-12) ranks. Why does "late fusion" help? It orders the list!'
    ends = {i + 1 for i, c in enumerate(text) if c in ".?!"}
    for n in range(1, len(text)):
        if not text[:n].strip():
            continue
        assert (T.examine(text[:n]) == "whole") == (len(text[:n].rstrip()) in ends and text[:n].rstrip()[-1] in ".?!"), text[:n]
        for tail in ("...", "…", " [more]", "\n-- feed"):
            if len(text[:n].rstrip()) not in ends:
                assert T.examine(text[:n] + tail) != "whole"


def test_rates_and_baselines(spark, rows):
    data = [(i, "Whole text.", " Good ") for i in range(8)] + [(20, "cut off he", "good"), (21, None, "good"), (22, "", "good"), (23, "no source", None)]
    data += [(100 + i, "a title without end", "loose") for i in range(120)] + [(300 + i, "one) of (two.", "open") for i in range(120)] + [(500, "An open (bracket.", "good")] + [(200, "a cut title...", "loose"), (201, "Done.", "loose")]
    d = spark.createDataFrame([(*r, True, "x") for r in data], "doc_id long, text string, source string, cut boolean, n string")
    found = T.examined(d)
    assert rows(found.filter("cut"), "doc_id") == [(20,), (200,), (23,), (500,)]
    assert rows(found.filter("cut IS NULL"), "doc_id") == [(21,), (22,)]
    assert rows(T.cut_rates(found), "source", "texts", "cut", "unfinished") == [("", 1, 1, 1), ("good", 10, 2, 1), ("loose", 122, 1, 0), ("open", 120, 0, 0)]
    assert T.examined(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [19, 20, 300])
def test_queries_find_all_texts_of_a_source_that_is_cut_everywhere(spark, tmp_path, rows, n):
    from sparkir.llm import queries as Q

    data = [(i, f"A whole sentence. And number {i} stops in", "limited") for i in range(n)] + [(1000 + i, "Whole text.", "good") for i in range(n)] + [(5000, None, "limited"), (5001, " ", "good")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(Q.p10_found(spark, str(tmp_path))) == sorted([(i,) for i in range(n)], key=repr)
    assert rows(Q.p10_rates(spark, str(tmp_path))) == [("good", n, 0, 0.0), ("limited", n, n, 1.0)]
    assert rows(Q.p10_evidence(spark, str(tmp_path)), "source", "unfinished") == [("good", 0), ("limited", n)]


def test_baselines_grow_steadily(spark):
    said = []
    for n in (1, 10, 30, 60, 200):
        d = spark.createDataFrame([(i, "a title", "s") for i in range(n)], "doc_id long, text string, source string")
        said.append(T.examined(d).filter("cut").count() == n)
    assert said == sorted(said, reverse=True) and said[0] and not said[-1]


def test_only_the_automaton_finds_what_stays_open(spark, tmp_path, rows):
    from sparkir.llm import queries as Q

    data = [(1, "Nested (one [two]. A full stop.", "s"), (2, 'He said "so it is. And went.', "s"), (3, "Whole (all of it). Done.", "s"), (4, "<p>Left <b>open.", "s")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(Q.p10_found(spark, str(tmp_path))) == [(1,), (2,), (4,)]
