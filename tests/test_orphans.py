from datetime import datetime as D

from pyspark.sql import functions as F

from sparkir.operators import orphans as O

DOC = "doc_id long, metadata struct<topic:string,entities:array<string>,relations:array<struct<relation:string,source:string,target:string>>>, ingested_at timestamp_ntz, field string, node_key string"
M = D(2024, 5, 1)


def docs(spark, rows):
    return spark.createDataFrame([(i, m, t, "clash", "clash") for i, m, t in rows], DOC)


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, node_key string").select(O.normal_key("node_id").alias("parent_key"), "created_at", "deleted_at")


def found(spark, documents, parents, **kw):
    refs = O.document_references(documents)
    out = O.orphan_references(refs, parents, "node_key", "parent_key", "ingested_at", "created_at", "deleted_at", **kw)
    return refs, out


def test_references_are_normalised_and_distinct(spark, rows):
    d = docs(spark, [
        (1, ("t", [" CON-0000001 ", "con-0000001", "Some Name", None, "", "con-00000012", "con-000001"], [("r", None, "per-0000002"), None, ("r", "doc-0000003\t", None)]), M),
        (2, None, M), (3, ("t", None, None), M), (4, ("t", [], []), None),
    ])
    assert rows(O.document_references(d), "doc_id", "field", "node_key") == [(1, "entities", "con-0000001"), (1, "source", "doc-0000003"), (1, "target", "per-0000002")]


def test_existence_in_time(spark, rows):
    d = docs(spark, [(i, (None, [k], None), t) for i, k, t in [
        (1, "con-0000001", M), (2, "con-0000002", M), (3, "con-0000003", M), (4, "con-0000004", M), (5, "con-0000005", M), (6, "con-0000001", None), (7, "con-0000006", None), (8, "con-0000007", M)]])
    p = nodes(spark, [
        ("con-0000001", None, None, "x"), ("con-0000001", None, None, "x"),
        ("con-0000002", D(2024, 6, 1), None, "x"),  # comes later
        ("con-0000003", None, M, "x"),  # gone at that moment
        (" CON-0000004", M, D(2024, 5, 2), "x"),  # created at that moment
        ("con-0000006", D(2020, 1, 1), None, "x"),
        ("con-0000007", D(2020, 1, 1), D(2021, 1, 1), "x"), ("con-0000007", D(2024, 1, 1), None, "x"),
        (None, None, None, "x"),
    ])
    for kw in ({}, {"least": 1}):
        refs, out = found(spark, d, p, **kw)
        assert rows(out, "doc_id", "reason") == [(2, "absent"), (3, "absent"), (5, "missing"), (7, "absent")]
    report = rows(O.orphan_report(refs, out, "field", "ingested_at"), "field", "period", "references", "orphans")
    assert report == [("entities", "2024-05", 6, 3), ("entities", None, 2, 1)]


def test_without_time_and_with_empty_tables(spark, rows):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "doc_id long, key string")
    parents = spark.createDataFrame([("a",), (None,)], "pk string")
    assert rows(O.orphan_references(refs, parents, "key", "pk"), "doc_id", "key") == [(2, "b"), (2, "b")]
    assert O.orphan_references(refs.limit(0), parents, "key", "pk").count() == 0
    assert O.orphan_references(refs, parents.limit(0), "key", "pk").count() == 3
    refs2, out = found(spark, docs(spark, []), nodes(spark, []))
    assert out.count() == 0 and O.orphan_report(refs2, out, "field", "ingested_at").count() == 0


def test_hot_key_is_salted(spark):
    d = docs(spark, [(i, (None, ["con-0000001" if i % 2 else f"con-{i:07d}"], None), M) for i in range(200)])
    p = nodes(spark, [("con-0000001", None, None, "x")])
    _, out = found(spark, d, p, least=10)
    assert out.count() == 100
    assert out.filter(F.col("node_key") == "con-0000001").count() == 0
