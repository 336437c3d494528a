"""python -m sparkir.cli CORPUS.json: a small menu over one corpus."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from sparkir.plans.engine import SearchEngine, create_search_engine
from sparkir.session import build_session
from sparkir.sources.corpus import attach_text, load_corpus

ENTRIES = (("Lexical BM25", ("lexical",)), ("Dense Retrieval", ("dense",)), ("Graph Retrieval", ("graph",)), ("Hybrid Retrieval", ("hybrid",)), ("Hybrid + Reranking", ("hybrid", "reranking")), ("RAG / Answer", ("hybrid", "reranking", "generation")))


def menu(engine: SearchEngine) -> list[str]:
    have = engine.capabilities()
    lines = [f"{i}. {name} - {'AVAILABLE' if all(have[n] for n in needs) else 'NOT CONFIGURED'}" for i, (name, needs) in enumerate(ENTRIES, 1)]
    return [*lines, f"{len(ENTRIES) + 1}. Exit"]


def run_mode(engine: SearchEngine, choice: int, text: str, top_k: int):
    """The result rows of one menu entry for one query; RuntimeError if it is not configured."""
    if not 1 <= choice <= len(ENTRIES):
        raise ValueError("no such entry")
    have = engine.capabilities()
    if not all(have[n] for n in ENTRIES[choice - 1][1]):
        raise RuntimeError(f"{ENTRIES[choice - 1][0]} is not configured")
    q = engine.documents.sparkSession.createDataFrame([(1, text)], "query_id long, text string")
    if choice == 6:
        return engine.answer(q, top_k)
    if choice == 5:
        found = engine.rerank(q, engine.hybrid.retrieve(q, top_k), top_k)
    elif choice == 4:
        found = engine.hybrid.retrieve(q, top_k)
    else:
        found = engine.hybrid.retrievers[ENTRIES[choice - 1][1][0]](q, top_k)
    return attach_text(found, engine.documents).orderBy("rank").select("rank", "document_id", F.round("score", 4).alias("score"), "text")


def main(argv: list[str]) -> int:
    spark = build_session()
    engine = create_search_engine(load_corpus(spark, argv[0]), configure_optional=True)
    while True:
        print("\n".join(menu(engine)))
        choice = input("Choice: ").strip()
        if choice == str(len(ENTRIES) + 1):
            return 0
        text, k = input("Query: ").strip(), input("Top_k (positive integer): ").strip()
        if not choice.isdigit() or not k.isdigit() or int(k) < 1 or not text:
            print("Enter a number of the menu, a query and a positive integer.")
            continue
        try:
            for r in run_mode(engine, int(choice), text, int(k)).collect():
                print(" | ".join(map(str, r)))
        except (RuntimeError, ValueError) as e:
            print(e)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
