"""Index tables and corpus statistics: tokens, postings, positions, vocabulary, lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkir.functions.text import Analyzer
from sparkir.session import stage


def tokens(documents: DataFrame, analyzer: Analyzer | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, term): positions are counted after stop words went, so they close the gaps."""
    terms = (analyzer or Analyzer(stem=False))(text)
    return documents.select(F.col(doc).alias("doc_id"), F.posexplode(terms).alias("pos", "term"))


def postings(toks: DataFrame) -> DataFrame:
    """(term, doc_id, tf); combined before the shuffle."""
    return toks.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def packed_postings(documents: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(doc_id, dl, terms, tfs): a row per document that has terms, with its length. Texts move once, by document; their
    terms are counted where they arrive."""
    toks = tokens(documents.select("doc_id", "text").repartition("doc_id"), analyzer)
    one = postings(toks).groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("p"))
    return one.select("doc_id", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))


def unpacked(packed: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of packed postings."""
    p = packed.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return p.select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").alias("tf"), "dl").hint("merge")


def positional_index(toks: DataFrame) -> DataFrame:
    """(term, doc_id, positions): the ascending positions of each term in each document, bounded by the document."""
    return toks.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def forward_index(posts: DataFrame) -> DataFrame:
    """(doc_id, terms): a map from term to tf, bounded by the document."""
    return posts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("terms"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def document_lengths(documents: DataFrame, posts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, dl) of every document, 0 for one without terms."""
    dl = posts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return documents.select(F.col(doc).alias("doc_id")).join(dl, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))


def corpus_stats(documents: DataFrame, posts: DataFrame) -> DataFrame:
    """One row (n, total, avgdl): documents without terms count, and avgdl is 0.0 for an empty corpus."""
    n = documents.agg(F.count("*").alias("n"))
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return n.join(F.broadcast(total)).select("n", "total", F.when(F.col("n") == 0, 0.0).otherwise(F.col("total") / F.col("n")).alias("avgdl"))


def vocabulary(toks: DataFrame) -> DataFrame:
    """(term, term_id): dense ids from 0 in order of first sight (least document, then position).

    First sights are partitioned by ranges and stored with the number of theirs, terms are numbered inside a range, and the
    sizes of the ranges before are added, whatever the ids look like; there is one size per partition.
    """
    first = toks.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("term", "f.doc_id", "f.pos")
    ranged = stage(first.repartitionByRange("doc_id", "pos", "term").withColumn("__range", F.spark_partition_id()), "sights")
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before, so_far = [], 0
    for r in sorted(sizes):
        before.append((r, so_far))
        so_far += sizes[r]
    table = toks.sparkSession.createDataFrame(before, "__range int, __before long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("doc_id", "pos", "term"))
    return ranged.withColumn("__i", inside).join(F.broadcast(table), "__range").select("term", (F.col("__i") - 1 + F.col("__before")).cast("long").alias("term_id"))


def term_frequency(posts: DataFrame, wanted: DataFrame, stem: Column | None = None) -> DataFrame:
    """wanted (doc_id, term) with tf: that of the exact term, else that of its stem (a column of wanted), else 0.

    Both sides grow with the documents, and the size that Spark expects of exploded texts is far too small: the hints keep it
    from broadcasting postings."""
    exact = posts.select("doc_id", F.col("term"), F.col("tf").alias("__exact"))
    out = wanted.hint("merge").join(exact.hint("merge"), ["doc_id", "term"], "left")
    if stem is None:
        return out.withColumn("tf", F.coalesce("__exact", F.lit(0))).drop("__exact")
    by_stem = posts.select("doc_id", F.col("term").alias("__stem"), F.col("tf").alias("__stemmed"))
    out = out.withColumn("__stem", stem).hint("merge").join(by_stem.hint("merge"), ["doc_id", "__stem"], "left")
    return out.withColumn("tf", F.coalesce("__exact", "__stemmed", F.lit(0))).drop("__exact", "__stemmed", "__stem")


def document_frequency(dfs: DataFrame, wanted: DataFrame, stem: Column | None = None) -> DataFrame:
    """wanted (term) with df: that of the exact term, else that of its stem, else 0."""
    out = wanted.join(dfs.select("term", F.col("df").alias("__exact")), "term", "left")
    if stem is None:
        return out.withColumn("df", F.coalesce("__exact", F.lit(0))).drop("__exact")
    out = out.withColumn("__stem", stem).join(dfs.select(F.col("term").alias("__stem"), F.col("df").alias("__stemmed")), "__stem", "left")
    return out.withColumn("df", F.coalesce("__exact", "__stemmed", F.lit(0))).drop("__exact", "__stemmed", "__stem")


@dataclass
class Index:
    """The tables of one corpus, all lazily defined from its documents."""

    documents: DataFrame
    tokens: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame
    stats: DataFrame
    analyzer: Analyzer
    packed: DataFrame | None = None

    def write(self, path: str, parts: int | None = None) -> None:
        """Postings that are kept packed are saved so, without moving them; others are clustered by term, so that row groups
        can be skipped by the terms a query asks for."""
        if self.packed is not None:
            self.packed.write.mode("overwrite").parquet(f"{path}/packed")
        else:
            p = self.postings.repartition(parts, "term") if parts else self.postings.repartition("term")
            p.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("tokens", "frequencies", "lengths", "stats", "documents"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str, analyzer: Analyzer) -> Index:
        parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("documents", "tokens", "frequencies", "lengths", "stats")}
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/packed")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return Index(**parts, postings=spark.read.parquet(f"{path}/postings"), analyzer=analyzer)
        packed = spark.read.parquet(f"{path}/packed")
        return Index(**parts, postings=unpacked(packed), analyzer=analyzer, packed=packed)


def build_index(documents: DataFrame, analyzer: Analyzer | None = None, store: bool = False) -> Index:
    """documents (doc_id, text): ids must be unique, which loaders check; null texts are documents without terms.

    store: whether the postings are computed now and kept in the shared folder, packed by document, so that the texts are
    analyzed once for all tables that derive from them. Kept postings carry dl, the length of their document."""
    a = analyzer or Analyzer()
    t = tokens(documents, a)
    if not store:
        p = postings(t)
        return Index(documents, t, p, document_frequencies(p), document_lengths(documents, p), corpus_stats(documents, p), a)
    packed = stage(packed_postings(documents, a), "postings")
    dl = packed.select("doc_id", F.col("dl").alias("tf"))  # the tables of sums read no terms
    df = packed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Index(documents, t, unpacked(packed), df, document_lengths(documents, dl), corpus_stats(documents, dl), a, packed)
