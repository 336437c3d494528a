import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkir import cli
from sparkir.functions import providers
from sparkir.functions import vectors as V
from sparkir.operators import ann, dense, evaluation
from sparkir.operators import graph as G
from sparkir.operators.ranking import occurrences
from sparkir.plans import planning, rag
from sparkir.plans.engine import GenerationFailure, RetrievalFailure, SearchEngine, create_search_engine
from sparkir.plans.hybrid import HybridRetriever
from sparkir.sources import store
from sparkir.streaming import incremental

VEC = "vec_id string, ord long, embedding array<double>, metadata string"
DOCS = "doc_id long, text string, metadata struct<topic:string,entities:array<string>,relations:array<struct<relation:string,source:string,target:string>>>"


def vectors(spark, data):
    return spark.createDataFrame([(n, i, [float(x) for x in v] if v else v, m) for i, (n, v, m) in enumerate(data)], VEC)


def asks(spark, *v):
    return spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(v, 1)], "query_id long, embedding array<double>")


def names(df):
    return [r[0] for r in df.orderBy("query_id", "rank").select("vec_id").collect()]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    got = df.select(V.dot("a", "b"), V.cosine("a", "b"), V.euclidean("a", "b"), V.cosine("a", "z", "zero"), V.valid_vector("a", 2), V.valid_vector("s", 2)).first()
    assert list(got) == pytest.approx([11.0, 11 / (5**0.5 * 5), 8**0.5, 0.0, True, False])
    for c in (V.dot("a", "s"), V.cosine("a", "z")):
        with pytest.raises(Exception, match="dimension|direction"):
            df.select(c).collect()


def test_exact_search(spark):
    s = vectors(spark, [("right", [1, 0], '{"category":"x"}'), ("up", [0, 1], '{"category":"y"}'), ("diagonal", [0.8, 0.2], None)])
    assert names(dense.exact_knn(s, asks(spark, [1, 0]), 2)) == ["right", "diagonal"]
    assert names(dense.exact_knn(s, asks(spark, [1, 0]), 5, where=dense.matches_filter({"category": "y"}))) == ["up"]
    assert names(dense.exact_knn(s, asks(spark, [1, 0]), 5, where=dense.matches_filter({"category": None}))) == ["diagonal"]
    assert names(dense.exact_knn(vectors(spark, [("small", [1, 0], None), ("large", [10, 0], None)]), asks(spark, [1, 0]), 1, "dot")) == ["large"]
    assert names(dense.exact_knn(vectors(spark, [("far", [10, 10], None), ("near", [1, 1], None)]), asks(spark, [0, 0]), 2, " Euclidean ")) == ["near", "far"]
    assert names(dense.exact_knn(vectors(spark, [("first", [1, 0], None), ("second", [1, 0], None)]), asks(spark, [1, 0]), 2)) == ["first", "second"]
    assert dense.exact_knn(s.limit(0), asks(spark, [1, 0]), 2).count() == 0 and dense.exact_knn(s, asks(spark), 2).count() == 0
    with pytest.raises(ValueError):
        dense.exact_knn(s, asks(spark, [0, 0]), 2)
    with pytest.raises(Exception, match="dimension"):
        dense.exact_knn(s, asks(spark, [1, 0, 0]), 2).collect()
    for bad, error in ((dict(k=0), ValueError), (dict(k=True), TypeError), (dict(metric="l1"), ValueError)):
        with pytest.raises(error):
            dense.exact_knn(s, asks(spark, [1, 0]), **bad)


def test_exact_search_equals_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    s = vectors(spark, [(str(i), v.tolist(), None) for i, v in enumerate(x)])
    got = dense.exact_knn(s.repartition(5), asks(spark, *x[:20].tolist()), 7, block=6).collect()
    c = (x[:20] @ x.T) / np.linalg.norm(x[:20], axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    for q in range(20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q + 1), key=lambda r: r.rank)] == [str(j) for j in np.argsort(-c[q], kind="stable")[:7]]


def test_store_changes(spark, rows, tmp_path):
    s = vectors(spark, [("a", [1, 0], None), ("b", [0, 1], '{"k":1}')])
    new = spark.createDataFrame([(" c ", [1.0, 1.0], None)], "vec_id string, embedding array<double>, metadata string")
    assert rows(dense.add_vectors(s, new), "vec_id") == [("a",), ("b",), ("c",)]
    for bad in ([("a", [1.0, 1.0], None)], [("d", [1.0], None)], [("d", [float("nan"), 1.0], None)], [(" ", [1.0, 1.0], None)]):
        with pytest.raises(ValueError):
            dense.add_vectors(s, spark.createDataFrame(bad, new.schema))
    change = spark.createDataFrame([("b", [5.0, 5.0], None)], new.schema)
    assert rows(dense.update_vectors(s, change), "vec_id", "embedding", "metadata") == [("a", [1.0, 0.0], None), ("b", [5.0, 5.0], '{"k":1}')]
    for f in (lambda: dense.update_vectors(s, spark.createDataFrame([("z", [1.0, 1.0], None)], new.schema)), lambda: dense.get_vector(s, "z"), lambda: dense.delete_vectors(s, spark.createDataFrame([("z",)], "vec_id string"))):
        with pytest.raises(KeyError):
            f()
    assert rows(dense.delete_vectors(s, spark.createDataFrame([("a",)], "vec_id string")), "vec_id") == [("b",)]
    edges = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a")], "node_id string, layer int, neighbor_id string")
    store.save(str(tmp_path / "s"), s, 2, edges=edges)
    v, e, m = store.load(spark, str(tmp_path / "s"))
    assert rows(v) == rows(s) and rows(e) == rows(edges) and m["metric"] == "cosine"
    with pytest.raises(ValueError):
        store.save(str(tmp_path / "t"), s, 3)
    with pytest.raises(ValueError):
        store.save(str(tmp_path / "t"), s, 2, edges=edges.withColumn("neighbor_id", F.lit("zz")))


def test_small_worlds():
    x = np.random.default_rng(123).uniform(-1, 1, (200, 8))
    g = ann.SmallWorld(x, m=8, ef_construction=80, seed=123)
    assert all(len(layers[0]) <= 16 and all(len(near) <= 8 for near in layers[1:]) for layers in g.links)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    recall = np.mean([len({i for _, i in g.search(q, 5, 80)} & set(np.argsort(-(n @ (q / np.linalg.norm(q))))[:5])) / 5 for q in np.random.default_rng(5).uniform(-1, 1, (30, 8))])
    assert recall >= 0.9
    hit = g.search(x[7], 1)[0][1]
    g.remove(hit)
    assert g.search(x[7], 1)[0][1] != hit and all(hit not in near for layers in g.links for near in layers)
    assert ann.SmallWorld(np.empty((0, 3))).search(np.ones(3)) == []
    with pytest.raises(ValueError):
        ann.SmallWorld(x, m=1)


def test_sharded_search(spark):
    x = np.random.default_rng(2).normal(size=(240, 6))
    s = vectors(spark, [(str(i), v.tolist(), None) for i, v in enumerate(x)])
    q = asks(spark, *x[:15].tolist())
    got = ann.ann_search(s, q, k=5, shard_rows=80, block=10)
    r = ann.recall_at_k(got, dense.exact_knn(s, q, 5), 5).agg(F.avg("recall")).first()[0]
    assert r >= 0.9
    less = ann.ann_search(s, q, k=1, shard_rows=80, removed=spark.createDataFrame([(str(i),) for i in range(15)], "vec_id string"))
    assert not {r.vec_id for r in less.collect()} & {str(i) for i in range(15)}
    e = ann.build_edges(s, m=4, ef_construction=20, shard_rows=80)
    store.check_edges(s, e, 4)


def graph(spark):
    n = spark.createDataFrame([("query", "entity", "{}"), ("entity", "entity", '{"name":"machine"}'), ("document", "document", "{}"), ("lone", "entity", "{}")], "node_id string, node_type string, metadata string")
    e = spark.createDataFrame([("query", "entity", "r", 1.0, "{}", 0), ("query", "entity", "s", 1.0, "{}", 1), ("entity", "document", "r", 1.0, "{}", 2), ("document", "query", "r", 1.0, "{}", 3)], "src string, dst string, edge_type string, weight double, metadata string, ord long")
    return n, e


def test_graph(spark, rows):
    n, e = graph(spark)
    G.check_graph(n, e)
    s = spark.createDataFrame([(1, "query"), (2, "lone")], "query_id long, node_id string")
    assert rows(G.bfs(s, e)) == [(1, "document", 2), (1, "entity", 1), (1, "query", 0), (2, "lone", 0)]
    assert rows(G.bfs(s, e, 0)) == [(1, "query", 0), (2, "lone", 0)]
    assert rows(G.k_hop(s, e, 1)) == [(1, "entity", 1)]
    assert rows(G.adjacency(e).filter("src = 'query'")) == [("query", ["entity", "entity"])]
    assert G.first_edges(e).count() == 3
    assert rows(G.degrees(n, e))[3] == ("query", 2, 1)
    n2, e2 = G.remove_nodes(n, e, spark.createDataFrame([("entity",)], "node_id string"))
    assert n2.count() == 3 and rows(e2, "src", "dst") == [("document", "query")]
    for f, error in ((lambda: G.add_edges(n, e, e.withColumn("dst", F.lit("zz"))), KeyError), (lambda: G.add_nodes(n, n), ValueError), (lambda: G.get_node(n, "zz"), KeyError)):
        with pytest.raises(error):
            f()


def test_depth_first(spark):
    e = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 2), ("c", "d", 3), ("c", "b", 4)], "src string, dst string, ord long")
    s = spark.createDataFrame([(1, "a"), (2, "x")], "query_id long, node_id string")
    got = G.dfs(s, e).orderBy("query_id", "step").collect()
    assert [(r.query_id, r.node_id, r.depth) for r in got] == [(1, "a", 0), (1, "b", 1), (1, "d", 2), (1, "c", 1), (2, "x", 0)]


def test_graph_of_a_corpus(spark, rows):
    d = spark.createDataFrame([
        (1, "t1", ("x", [" python ", None, "", "python"], [("uses", None, "language"), ("uses", "python", "language"), ("aids", "python", "language"), ("", "a", "b"), None])),
        (2, "t2", ("y", None, [("made_by", None, "x"), ("part_of", "programming", "python")])), (3, None, None)], DOCS)
    n, e = G.build_graph(d)
    G.check_graph(n, e)
    assert rows(n, "node_id", "node_type") == [("1", "document"), ("2", "document"), ("3", "document"), ("language", "entity"), ("programming", "entity"), ("python", "entity")]
    assert rows(e, "src", "dst", "edge_type") == [("programming", "python", "part_of"), ("python", "1", "mentioned_in"), ("python", "language", "aids")]
    q = spark.createDataFrame([(1, "Programming?"), (2, "zzz")], "query_id long, text string")
    assert rows(G.graph_retrieve(q, n, e), "query_id", "document_id", "rank") == [(1, "1", 1)]
    only = spark.createDataFrame([("python",)], "node_id string")
    assert G.graph_retrieve(q, n, e, starts=only).count() == 0
    assert G.build_graph(d.limit(0))[1].count() == 0


@pytest.fixture
def engine(spark):
    d = spark.createDataFrame([(1, "machine learning guide", ("t", ["machine"], None)), (2, "machine learning machine", ("t", ["machine", "vision"], [("rel", "machine", "vision")])), (3, "cats and dogs", None)], DOCS)
    return SearchEngine(d, score=occurrences, generate=lambda q, c: F.when(c.isNotNull(), F.concat(F.lit("grounded in "), F.size(F.split(c, r"\[SOURCE ")) - 1)))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def test_planner(spark):
    q = ask(spark, "machine", "what is machine learning about", "related connected dependency", '"machine related"', "explain it in a few words now", "look at CVE-2024-12345 or AB-12 x", "one two three", "compare cats versus dogs ok")
    got = {r.query_id: r for r in planning.plan(q, 4).collect()}
    modes = [(got[i].primary_mode, got[i].enabled_modes) for i in range(1, 9)]
    assert modes[:4] == [("lexical", ["lexical"]), ("dense", ["dense"]), ("graph", ["graph"]), (got[4].primary_mode, ["lexical", "graph"])]
    assert got[4].primary_mode == "hybrid" and got[4].confidence == 0.5
    assert modes[4] == ("dense", ["lexical", "dense"]) and modes[5][0] == "lexical" and modes[6] == ("hybrid", ["lexical", "dense", "graph"]) and modes[7] == ("hybrid", ["dense", "graph"])
    assert got[1].candidate_k == 20 and got[1].max_graph_hops == 0 and got[3].max_graph_hops == 2
    with pytest.raises(ValueError):
        planning.plan(ask(spark, " "))
    with pytest.raises(ValueError):
        planning.plan(q, 0)


def test_facade(spark, engine):
    assert engine.capabilities() == {"lexical": True, "dense": False, "graph": True, "hybrid": True, "reranking": True, "generation": True}
    got = engine.retrieve(ask(spark, "machine", '"machine related"'), 5).orderBy("query_id", "rank").collect()
    assert [r.document_id for r in got if r.query_id == 1] == ["2", "1"] and {r.document_id for r in got if r.query_id == 2} == {"1", "2"}
    with pytest.raises(RetrievalFailure):
        engine.retrieve(ask(spark, "what is it"))
    a = {r.query_id: r for r in engine.answer(ask(spark, "machine", '"zebra"'), 2).collect()}
    assert a[1].answer == "grounded in 2" and a[1].document_ids == ["2", "1"] and a[2].answer is None and a[2].document_ids == []
    with pytest.raises(GenerationFailure):
        SearchEngine(engine.documents).answer(ask(spark, "machine"))
    assert create_search_engine(engine.documents, True).capabilities()["lexical"]
    assert cli.menu(engine)[1].endswith("NOT CONFIGURED") and [r.document_id for r in cli.run_mode(engine, 5, "machine", 3).collect()] == ["2", "1"]
    with pytest.raises(RuntimeError):
        cli.run_mode(engine, 2, "machine", 3)
    for bad in ({}, {"x": len}):
        with pytest.raises(ValueError):
            HybridRetriever(bad)


def test_context(spark):
    e = spark.createDataFrame([(1, "7", "abc", 0.5, 1), (1, "8", "d" * 50, 0.4, 2), (1, "9", "e", 0.3, 3)], "query_id long, document_id string, text string, score double, rank int")
    full = rag.context(e).first()
    assert full.context.startswith("[SOURCE 1]\ndocument_id: 7\nretrieval_score: 0.500000\ntext:\nabc\n\n[SOURCE 2]") and full.document_ids == ["7", "8", "9"]
    first = len(full.context.split("\n\n")[0])
    assert rag.context(e, first + 40).first().document_ids == ["7"]  # the second does not fit, the third is not tried
    assert rag.context(e, first - 1).count() == 0


def test_evaluation(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (2, "x", 1)], "query_id long, document_id string, rank int")
    rel = spark.createDataFrame([(1, "a", 1.0), (1, "c", 3.0), (1, "d", 1.0), (1, "b", 0.0), (3, "z", 1.0)], "query_id long, document_id string, relevance double")
    got = {r.query_id: r for r in evaluation.evaluate(run, rel, 2).collect()}
    r = got[1]
    assert (r.precision, r.recall, r.reciprocal_rank, r.precision_at_k) == (0.75, 1.0, 1.0, 0.5)
    assert r.recall_at_k == pytest.approx(1 / 3) and r.average_precision == pytest.approx((1 + 2 / 4) / 3)
    dcg = 1 + 1 / 2 + 7 / np.log2(5)
    assert r.ndcg == pytest.approx(dcg / (7 + 1 / np.log2(3) + 1 / 2)) and r.ndcg_at_k == 1.0
    assert list(got[2])[1:] == [0.0] * 8 and list(got[3])[1:] == [0.0] * 8
    m = evaluation.means(evaluation.evaluate(run, rel, 2)).first()
    assert m.queries == 3 and m.reciprocal_rank == pytest.approx(1 / 3)


def test_providers(spark):
    class Lengths(providers.EmbeddingModel):
        def embed_many(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    d = spark.createDataFrame([(1, "a"), (2, " bbbb ")], "doc_id long, text string")
    r = dense.DenseRetriever.from_documents(d, providers.embed_column(Lengths))
    assert [x.document_id for x in r.retrieve(ask(spark, "cccc"), 2).orderBy("rank").collect()] == ["2", "1"]
    assert providers.CountingCrossEncoder().score_batch("a", ["A b a", "c"]) == [2.0, 0.0]
    with pytest.raises(ValueError):
        Lengths().embed(" ")
    with pytest.raises(RuntimeError):
        providers.SentenceTransformerEmbedding()
    assert "Query: q" in spark.range(1).select(providers.prompt(F.lit("q"), F.lit("c"))).first()[0]


def test_streamed_index(spark, rows, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "doc_id long, text string"
    for batch in ([(1, "a1 b"), (2, "b")], [(1, "c c")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        incremental.index_stream(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    assert rows(incremental.latest_postings(spark, out)) == [("b", 2, 1), ("c", 1, 2)]
    ev = spark.sql("SELECT timestamp'2024-01-01 10:10:00' AS ts, 'x' AS event_type UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'x'")
    assert [r.events for r in incremental.windowed_counts(ev).collect()] == [2]


def test_whole_stored_queries_are_matched_as_phrases(spark, tmp_path, rows):
    from sparkir.queries_engine import QUERIES

    docs = [(1, "Fast dense retrieval ranks passages."), (2, "Dense retrieval of other passages ranks."), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "dense retrieval ranks"), (8, "dense retrieval")], "query_id long, text string").write.parquet(str(tmp_path / "queries.parquet"))
    assert rows(QUERIES["phrase_match"](spark, str(tmp_path)), "query_id", "doc_id") == [(7, 1), (8, 1), (8, 2)]


def test_indexes_are_kept_changed_and_loaded(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(240, 6))
    s = vectors(spark, [(str(i), v.tolist(), None) for i, v in enumerate(x)])
    q = asks(spark, *x[:20].tolist())
    exact = dense.exact_knn(s, q, 5)
    recall = lambda i, block=4096: ann.recall_at_k(ann.search_index(i, q, 5, block=block), exact, 5).agg(F.avg("recall")).first()[0]
    whole = ann.build_index(s, shard_rows=80).cache()
    assert recall(whole) >= 0.9 and recall(whole, 7) >= 0.9 and whole.count() == 240
    part = ann.build_index(s.filter("ord < 150"), shard_rows=80).cache()
    grown = ann.add_to_index(part, s.filter("ord >= 150")).cache()
    assert grown.count() == 240 and recall(grown) >= 0.9
    store.check_edges(s, ann.index_edges(grown), 16)
    with pytest.raises(ValueError):
        ann.add_to_index(part, s.filter("ord = 3"))
    less = ann.remove_from_index(grown, spark.createDataFrame([("0",), ("1",)], "vec_id string")).cache()
    assert less.count() == 238 and not {r.vec_id for r in ann.search_index(less, q, 3).collect()} & {"0", "1"}
    store.check_edges(s.filter("vec_id NOT IN ('0', '1')"), ann.index_edges(less), 16)
    store.save(str(tmp_path / "v"), s, 6, edges=ann.index_edges(whole))
    v, e, _ = store.load(spark, str(tmp_path / "v"))
    assert recall(ann.index_of(v, e).cache()) >= 0.9
    assert ann.search_index(whole.limit(0), q, 3).count() == 0
    lone = ann.index_of(vectors(spark, [("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None)]), spark.createDataFrame([], "shard int, node_id string, layer int, neighbor_id string"))
    assert {tuple(map(tuple, r.links)) for r in lone.collect()} == {((),)}


def test_exact_search_in_blocks(spark, rows):
    x = np.random.default_rng(8).normal(size=(90, 5))
    s = vectors(spark, [(str(i), v.tolist(), None) for i, v in enumerate(x)])
    q = asks(spark, *x[:23].tolist())
    for metric in ("cosine", "euclidean"):
        assert rows(dense.exact_knn(s, q, 4, metric, block=5, part_rows=20)) == rows(dense.exact_knn(s, q, 4, metric))


def test_metadata_filters_compare_values(spark, rows):
    data = [("a", '{"k":1}'), ("b", '{"k":"1"}'), ("c", '{"k":1.0}'), ("d", '{"k":true}'), ("e", '{"k":[1,"x"]}'), ("f", '{"k":{"u":1,"v":null}}'), ("g", '{"k":null}'), ("h", "{}"), ("i", None), ("j", "no json"), ("k", '{"k":[1,"y"]}')]
    df = spark.createDataFrame(data, "vec_id string, metadata string")
    found = lambda **w: "".join(r[0] for r in rows(df.filter(dense.matches_filter(w)), "vec_id"))
    assert found(k=1) == found(k=1.0) == found(k=True) == "acd" and found(k="1") == "b" and found(k=[1, "x"]) == "e"
    assert found(k={"v": None, "u": 1}) == "f" and found(k=None) == "ghij" and found(k=2) == "" and found() == "abcdefghijk"


def test_fusion_keeps_the_metadata_of_the_first_list(spark):
    lists = spark.createDataFrame([(1, "b", 0, "x", 1, "mb"), (1, "a", 1, "x", 1, "ma"), (1, "a", 1, "y", 2, "my"), (1, "a", 1, "y", 3, "later")], "query_id long, list string, list_at int, document_id string, rank int, metadata string")
    from sparkir.operators.ranking import rrf

    assert {r.document_id: r.metadata for r in rrf(lists).collect()} == {"x": "mb", "y": "my"}
    assert {r.document_id: r.metadata for r in rrf(lists.drop("list_at")).collect()} == {"x": "ma", "y": "my"}


def test_edges_of_large_document_ids_are_ordered(spark):
    data = [(1 << 50, "x", ("t", ["B", "A"], None)), ((1 << 50) + 1, "y", ("t", ["A"], [("r", "A", "B")]))]
    docs = spark.createDataFrame(data, "doc_id long, text string, metadata struct<topic:string,entities:array<string>,relations:array<struct<relation:string,source:string,target:string>>>")
    edges = G.build_graph(docs)[1]
    assert {r.src: r.neighbors for r in G.adjacency(edges).collect()} == {"A": [str(1 << 50), str((1 << 50) + 1), "B"], "B": [str(1 << 50)]}
