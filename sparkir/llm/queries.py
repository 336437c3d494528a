"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkir.llm import distinctive, mixing, names, nearest, neardup, packing, rankfuse, terms, tokens, truncation
from sparkir.operators import dense
from sparkir.session import stage


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_models(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "postings")
    models = distinctive.term_models(terms.counted_postings(posts, together=True), together=True, vocabulary=terms.vocabulary_size(posts))
    return models.withColumn("background", F.round("background", 9)).withColumn("probability", F.round("probability", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "postings")
    return distinctive.found_terms(terms.counted_postings(posts, together=True), together=True, vocabulary=terms.vocabulary_size(posts))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = rankfuse.fuse(table(spark, d, "results"), table(spark, d, "queries")).drop("shortest")
    return fused.withColumn("significance", F.round(-F.log("significance"), 6)).withColumnRenamed("significance", "log_significance")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.agreed(rankfuse.fuse(table(spark, d, "results"), table(spark, d, "queries")))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").count()
    return terms.term_frequency(terms.counted_postings(table(spark, d, "postings")), n)


def p4_text_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return terms.term_frequency(terms.text_postings(docs), docs.count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).filter("mark IS NOT NULL").select("term", "mark")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(names.typed_names(table(spark, d, "documents")))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(p5_clusters(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    v = nearest.usable_vectors(table(spark, d, "vectors"))
    return nearest.close_pairs(nearest.nearest(v, k=5, cosine=0.95, least=0.95), 0.95)


def p6_knn(spark: SparkSession, d: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 20; all vectors are searched."""
    v = nearest.usable_vectors(table(spark, d, "vectors"))
    asked = v.filter(F.expr("try_cast(vec_id AS BIGINT) % 20 = 0")).select("vec_id")
    return nearest.nearest(v, k=5, cosine=None, recall=0.9, radius=1, spread=0.5, per_bucket=16, words=3, queries=asked).withColumn("cosine", F.round("cosine", 6))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, neighbour): the five most similar vectors of p6_knn's queries, by exact search."""
    v = stage(nearest.usable_vectors(table(spark, d, "vectors")).withColumn("ord", F.lit(0).cast("long")), "vectors")
    asked = v.filter(F.expr("try_cast(vec_id AS BIGINT) % 20 = 0")).select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense.exact_knn(v, asked, 6).filter("query_id <> vec_id")  # itself is among the six unless six copies are before it
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("r", best).filter("r <= 5").select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"))


def _held(exact: DataFrame, lists: DataFrame) -> DataFrame:
    mine = exact.join(lists.select("vec_id").distinct(), "vec_id", "left_semi").join(lists.distinct().withColumn("__hit", F.lit(1)), ["vec_id", "neighbour"], "left")
    return mine.agg(F.count_distinct("vec_id").alias("queries"), F.round(F.avg(F.coalesce("__hit", F.lit(0)).cast("double")), 6).alias("recall"))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """(held_by, queries, recall): the share of the exact answers that the stored graph's neighbours and the saved hits hold,
    over the queries that they have."""
    exact = stage(p6_exact(spark, d), "exact")
    near = table(spark, d, "hnsw_nodes").filter("id IS NOT NULL").select(F.col("id").alias("vec_id"), F.explode(F.get("neighbors", F.lit(0))).alias("neighbour"))
    hits = table(spark, d, "vector_hits").filter("vec_id IS NOT NULL AND id IS NOT NULL").select("vec_id", F.col("id").alias("neighbour"))
    return _held(exact, near).select(F.lit("hnsw_nodes").alias("held_by"), "*").unionByName(_held(exact, hits).select(F.lit("vector_hits").alias("held_by"), "*"))


def p6_enough(spark: SparkSession, d: str) -> DataFrame:
    """(queries, enough): whether p6_knn holds at least 0.95 of the exact answers."""
    return _held(p6_exact(spark, d), stage(p6_knn(spark, d), "knn").select("vec_id", "neighbour")).select("queries", (F.col("recall") >= 0.95).alias("enough"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.document_pairs(*neardup.near_duplicates(table(spark, d, "documents"), least_words=30))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return neardup.duplicate_groups(*neardup.near_duplicates(docs), docs)


def sized_documents(spark: SparkSession, d: str, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens), kept so that texts are tokenized once."""
    docs = table(spark, d, "documents")
    return stage(docs.select("doc_id", truncation.normal_source("source").alias("source"), tokens.token_counter(folder)("text").alias("tokens")), "sized")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(sized_documents(spark, d), table(spark, d, "context_windows"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(texts, overfull, split): the texts that were packed, the windows that hold more than they can, and the texts in pieces
    that would have fitted whole."""
    sized, windows = sized_documents(spark, d), table(spark, d, "context_windows")
    packed = stage(packing.pack_texts(sized, windows), "packed")
    top = windows.agg(F.max("capacity_tokens")).first()[0]
    bins = packed.groupBy("bin_id", "capacity").agg(F.sum("tokens").alias("held")).agg(F.sum((F.col("held") > F.col("capacity")).cast("long")).alias("overfull"))
    texts = packed.groupBy("doc_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces")).join(sized.select("doc_id", F.col("tokens").alias("n")), "doc_id")
    texts = texts.agg(F.sum((F.col("held") == F.col("n")).cast("long")).alias("texts"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= top)).cast("long")).alias("split"))
    return texts.join(F.broadcast(bins)).select("texts", "overfull", "split")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packing(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = sized_documents(spark, d)
    return mixing.mixture(sized, mixing.repetition_rates(sized, table(spark, d, "source_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = sized_documents(spark, d)
    rates = mixing.repetition_rates(sized, table(spark, d, "source_targets"))
    return mixing.share_report(mixing.mixture(sized, rates), rates)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return truncation.examined(docs, exempt=False).filter("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return p10_evidence(spark, d).select("source", "texts", "cut", F.round("rate", 6).alias("rate"))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    rates = truncation.cut_rates(truncation.examined(table(spark, d, "documents").select("doc_id", "source", "text"), exempt=False))
    return rates.withColumn("rate", F.round("rate", 6))


QUERIES = {
    "p8_packing": p8_packing, "p8_checks": p8_checks, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p6_found": p6_found, "p6_knn": p6_knn, "p6_recall": p6_recall, "p6_enough": p6_enough,
    "p7_found": p7_found, "p7_groups": p7_groups,
    "p10_found": p10_found, "p10_rates": p10_rates, "p10_evidence": p10_evidence,
    "p2_found": p2_found, "p2_models": p2_models,
    "p3_found": p3_found, "p3_ranking": p3_ranking,
    "p5_found": p5_found, "p5_clusters": p5_clusters,
    "p4_found": p4_found, "p4_terms": p4_terms, "p4_text_terms": p4_text_terms,
}

COUNTED = """counted AS (
  SELECT term, doc_id, arg_max(tf, (coalesce(indexed_at, TIMESTAMP '0001-01-01'), tf)) AS tf FROM (
    SELECT lower(trim(term)) AS term, doc_id, coalesce(tf, 0) AS tf, indexed_at FROM postings WHERE trim(term) <> '' AND doc_id IS NOT NULL)
  GROUP BY 1, 2)"""

PLACED = """latest AS (
  SELECT query_id, signal, document_id, arg_max(strength, (coalesce(retrieved_at, TIMESTAMP '0001-01-01'), strength)) AS strength FROM (
    SELECT *, CASE WHEN coalesce(lower(metadata->>'$.metric'), '') = 'euclidean' THEN -score ELSE score END AS strength
    FROM results WHERE score IS NOT NULL AND NOT isnan(score) AND document_id IS NOT NULL AND signal IN ('lexical', 'dense', 'graph'))
  GROUP BY 1, 2, 3),
placed AS (
  SELECT *, rank() OVER (PARTITION BY query_id, signal ORDER BY strength DESC) AS place,
         count(*) OVER (PARTITION BY query_id, signal) AS n FROM latest),
own AS (
  SELECT query_id, signal, CASE signal WHEN 'lexical' THEN lexical_score WHEN 'dense' THEN dense_score ELSE graph_score END AS s
  FROM queries, (VALUES ('lexical'), ('dense'), ('graph')) v(signal)),
counting AS (
  SELECT query_id, signal, count(*) OVER (PARTITION BY query_id) AS lists FROM own o
  WHERE coalesce(s, 0) > 0 OR NOT EXISTS (SELECT 1 FROM own x WHERE x.query_id = o.query_id AND coalesce(x.s, 0) > 0))"""

TERM_SQL = """SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents,
  CASE WHEN count(*) < 2 THEN 'rare' WHEN count(*) >= 0.3 * (SELECT count(*) FROM documents) THEN 'common' END AS mark FROM {0} GROUP BY 1"""

RUNNING = r"""b AS (SELECT doc_id, source, rtrim(regexp_replace(text, '(\s*\n[ \t]*(-- |— |- |Signed, |Ref: |#)[^\n]*)*\s*$', ''), chr(10) || ' ') AS body FROM documents WHERE trim(text, chr(10) || ' ') <> ''),
    e AS (SELECT *, body <> '' AND (NOT regexp_matches(body, '[.!?]["'')]*$') OR body LIKE '%..') AS cut FROM b)"""

EXACT = """lv AS (SELECT vec_id, arg_max(embedding, ord) AS e FROM vectors WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1),
    v AS (SELECT vec_id, e FROM lv WHERE len(e) = 48 AND list_inner_product(e, e) > 0),
    xp AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE TRY_CAST(a.vec_id AS BIGINT) % 20 = 0),
    xr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS k FROM xp), x AS (SELECT vec_id, neighbour FROM xr WHERE k <= 5)"""

SQL = {
    "p10_rates": f"WITH {RUNNING} SELECT coalesce(lower(trim(source)), '') AS source, count(*) AS texts, count(*) FILTER (cut) AS cut, round(avg(cut::INT), 6) AS rate FROM e GROUP BY 1",
    # brackets and quotes are counted instead of nested
    "p10_evidence": f"""WITH {RUNNING}, o AS (SELECT *, body LIKE '%..' OR regexp_matches(body, '(…|[\\[(<]\\s*(\\.\\.+|…|[A-Za-zÀ-ÿ]+(\\s[A-Za-zÀ-ÿ]+)?)\\s*[\\])>])$') AS dots, regexp_matches(body, '(&#?\\w{{0,8}}|\\\\(u[0-9a-fA-F]{{0,3}}|x[0-9a-fA-F]?)?|%[0-9a-fA-F]|</?[a-zA-Z][^<>]*|</?)$') AS esc,
          len(replace(body, ')', '')) > len(replace(body, '(', '')) OR (len(body) - len(replace(body, '"', ''))) % 2 = 1 AS unclosed FROM e WHERE body <> '' OR NOT cut),
        k AS (SELECT coalesce(lower(trim(source)), '') AS source, CASE WHEN body = '' THEN 'whole' WHEN ends_with(body, chr(65533)) THEN 'bytes' WHEN dots THEN 'mark' WHEN NOT cut THEN CASE WHEN unclosed THEN 'open' ELSE 'whole' END WHEN esc THEN 'escape' ELSE 'unfinished' END AS kind FROM o)
        SELECT source, count(*) AS texts, count(*) FILTER (kind <> 'whole') AS cut, round(avg((kind <> 'whole')::INT), 6) AS rate, count(*) FILTER (kind = 'mark') AS mark, count(*) FILTER (kind = 'bytes') AS bytes,
          count(*) FILTER (kind = 'escape') AS escape, count(*) FILTER (kind = 'open') AS open, count(*) FILTER (kind = 'unfinished') AS unfinished FROM k GROUP BY 1""",
    "p3_ranking": f"""WITH {PLACED}, c AS (
          SELECT query_id, coalesce(max(CASE WHEN signal = 'lexical' THEN 1 END), 0) AS l, coalesce(max(CASE WHEN signal = 'dense' THEN 1 END), 0) AS d, coalesce(max(CASE WHEN signal = 'graph' THEN 1 END), 0) AS g FROM counting GROUP BY 1),
        w AS (SELECT query_id, document_id, max(place) FILTER (signal = 'lexical') AS pl, max(place) FILTER (signal = 'dense') AS pd, max(place) FILTER (signal = 'graph') AS pg FROM placed GROUP BY 1, 2),
        n AS (SELECT query_id, max(n) FILTER (signal = 'lexical') AS nl, max(n) FILTER (signal = 'dense') AS nd, max(n) FILTER (signal = 'graph') AS ng FROM placed GROUP BY 1),
        x AS (SELECT query_id, document_id, coalesce(l, 1) AS l, coalesce(d, 1) AS d, coalesce(g, 1) AS g, nl, nd, ng,
            CASE WHEN coalesce(l, 1) = 1 THEN pl END AS pl, CASE WHEN coalesce(d, 1) = 1 THEN pd END AS pd, CASE WHEN coalesce(g, 1) = 1 THEN pg END AS pg
          FROM w JOIN n USING (query_id) LEFT JOIN c USING (query_id)),
        y AS (SELECT *, l + d + g AS k, CASE WHEN l = 1 THEN coalesce(pl / nl, 1.0) END AS a, CASE WHEN d = 1 THEN coalesce(pd / nd, 1.0) END AS b, CASE WHEN g = 1 THEN coalesce(pg / ng, 1.0) END AS e
          FROM x WHERE coalesce(pl, pd, pg) IS NOT NULL),
        z AS (SELECT *, CAST(least(a, b, e) AS DOUBLE) AS lo, CAST(greatest(a, b, e) AS DOUBLE) AS hi, CAST(a + b + e AS DOUBLE) - CAST(least(a, b, e) AS DOUBLE) - CAST(greatest(a, b, e) AS DOUBLE) AS mi FROM y),
        s AS (SELECT *, CASE k WHEN 1 THEN least(1, lo) WHEN 2 THEN least(1, 2 * least(2 * lo * (1 - lo) + lo * lo, hi * hi))
            ELSE least(1, 3 * least(3 * lo * (1 - lo) * (1 - lo) + 3 * lo * lo * (1 - lo) + lo * lo * lo, 3 * mi * mi * (1 - mi) + mi * mi * mi, hi * hi * hi)) END AS rho FROM z)
        SELECT query_id, document_id, CAST(k AS INTEGER) AS lists, pl AS place_lexical, pd AS place_dense, pg AS place_graph, round(-ln(rho), 6) + 0 AS log_significance,
          rank() OVER (PARTITION BY query_id ORDER BY round(-ln(rho), 9) DESC) AS rank FROM s""",
    "p6_found": """WITH l AS (SELECT vec_id, arg_max(embedding, ord) AS e FROM vectors WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1),
        v AS (SELECT vec_id, e FROM l WHERE len(e) = 48 AND list_inner_product(e, e) > 0),
        p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS k FROM p)
        SELECT DISTINCT least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM r WHERE k <= 5 AND c >= 0.95""",
    "p6_enough": f"WITH {EXACT} SELECT count(DISTINCT vec_id) AS queries, true AS enough FROM x",
    "p6_recall": f"""WITH {EXACT}, l AS (SELECT DISTINCT 'hnsw_nodes' AS held_by, id AS vec_id, unnest(neighbors[1]) AS neighbour FROM hnsw_nodes UNION SELECT 'vector_hits', vec_id, id FROM vector_hits WHERE id IS NOT NULL),
        h AS (SELECT DISTINCT held_by, vec_id FROM l) SELECT h.held_by, count(DISTINCT x.vec_id) AS queries, round(avg((l.vec_id IS NOT NULL)::INT), 6) AS recall FROM h JOIN x USING (vec_id) LEFT JOIN l ON l.held_by = h.held_by AND l.vec_id = x.vec_id AND l.neighbour = x.neighbour GROUP BY 1""",
    "p8_checks": "SELECT count(DISTINCT doc_id) AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split FROM documents WHERE text <> ''",
    "p7_groups": r"""WITH RECURSIVE w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS b FROM documents),
        c AS (SELECT doc_id, CASE WHEN len(b) > 0 THEN min(doc_id) OVER (PARTITION BY b) ELSE doc_id END AS class_id, b FROM w),
        k AS (SELECT class_id, b, len(b) AS n FROM c WHERE doc_id = class_id AND len(b) > 0),
        p AS MATERIALIZED (SELECT x.class_id AS a, y.class_id AS b FROM k x JOIN k y ON x.class_id <> y.class_id AND x.n <= y.n * 1.25 AND y.n <= x.n * 1.25 WHERE len(list_intersect(x.b, y.b)) * 10 >= 8 * (x.n + y.n - len(list_intersect(x.b, y.b)))),
        g AS (SELECT a AS node, a AS label FROM p UNION SELECT p.b, g.label FROM g JOIN p ON p.a = g.node),
        m AS (SELECT node, min(label) AS group_id FROM g GROUP BY 1), l AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
        SELECT doc_id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(links, 0) AS links FROM c LEFT JOIN m ON node = class_id LEFT JOIN l ON a = class_id""",
    "p7_found": r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS b FROM documents), k AS (SELECT doc_id, b, len(b) AS n FROM w WHERE len(b) >= 30),
        p AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, x.n + y.n AS s, len(list_intersect(x.b, y.b)) AS i FROM k x JOIN k y ON x.doc_id < y.doc_id AND x.n <= y.n * 1.25 AND y.n <= x.n * 1.25)
        SELECT doc_a, doc_b FROM p WHERE i * 10 >= 8 * (s - i)""",
    "p10_found": r"""WITH b AS (SELECT doc_id, rtrim(regexp_replace(text, '(\s*\n[ \t]*(-- |— |- |Signed, |Ref: |#)[^\n]*)*\s*$', ''), chr(10) || ' ') AS body FROM documents WHERE trim(text, chr(10) || ' ') <> '')
        SELECT doc_id FROM b WHERE body <> '' AND (NOT regexp_matches(body, '[.!?]["'')]*$') OR body LIKE '%..')""",
    # expectation maximisation, a document leaving when its round changes it by no more than 1e-6
    "p2_models": f"""WITH RECURSIVE {COUNTED}, d AS (SELECT doc_id, sum(tf) AS total FROM counted GROUP BY 1), t AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counted GROUP BY 1),
        b AS (SELECT doc_id, term, CAST(tf AS DOUBLE) AS tf, CAST(total AS BIGINT) AS total, df, cf / (SELECT sum(cf) FROM t) AS bg FROM counted JOIN d USING (doc_id) JOIN t USING (term)),
        em AS (SELECT doc_id, term, tf, total, df, bg, CASE WHEN total > 0 THEN tf / total ELSE 0.0 END AS p, false AS done, 0 AS i FROM b
          UNION ALL SELECT doc_id, term, tf, total, df, bg, new, max(abs(new - p)) OVER (PARTITION BY doc_id) <= 1e-6, i + 1 FROM (
            SELECT *, x / greatest(sum(x) OVER (PARTITION BY doc_id), 1e-300) AS new FROM (SELECT *, tf * (0.1 * p) / greatest(0.1 * p + 0.9 * bg, 1e-300) AS x FROM em WHERE NOT done AND i < 200))),
        last AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY i DESC) AS k FROM em)
        SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, total AS doc_tf, df AS documents, round(bg, 9) AS background, round(p, 6) AS probability,
          CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, bg, term) AS INTEGER) AS rank FROM last WHERE k = 1""",
    "p2_found": f"""WITH {COUNTED}, d AS (SELECT doc_id, sum(tf) AS total FROM counted GROUP BY 1), t AS (SELECT term, count(*) AS df FROM counted GROUP BY 1)
        SELECT doc_id, term FROM counted JOIN d USING (doc_id) JOIN t USING (term) WHERE tf >= 3 AND tf * 25 >= total AND df BETWEEN 2 AND 8""",
    "p3_found": f"""WITH {PLACED} SELECT query_id, document_id FROM placed JOIN counting USING (query_id, signal)
        WHERE place <= 5 AND lists >= 2 GROUP BY 1, 2 HAVING count(*) = any_value(lists)""",
    "p4_found": f"WITH {COUNTED}, m AS ({TERM_SQL.format('counted')}) SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {COUNTED} {TERM_SQL.format('counted')}",
    "p4_text_terms": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), c AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2) " + TERM_SQL.format("c"),
}
