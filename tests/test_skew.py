import random

from pyspark.sql import functions as F

from sparkir.operators.skew import hot_keys, salted_join, spread_rank


def skewed(spark, n=600):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(40)}", i, float(r.randrange(50))) for i in range(n)]
    return spark.createDataFrame([*data, (None, n, 1.0)], "k string, i long, v double")


def test_hot_keys_are_exact_and_never_null(spark):
    df = skewed(spark)
    assert [k for k, _ in hot_keys(df, ["k"], parts=4, least=50)] == ["hot"]
    assert hot_keys(df, ["k"]) == []
    assert hot_keys(df.limit(0), ["k"], least=0) == []


def test_salted_join_equals_join(spark, rows):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 7), ("k1", 8), ("k1", 9), (None, 1)], "k string, w long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(left, right, ["k"], F.col("i"), how, parts=4, least=20).select(*left.columns)) == rows(left.join(right, "k", how).select(*left.columns))
    cond = F.col("w") > F.col("i") / 100
    plain = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & cond, "left_anti")
    assert rows(salted_join(left, right, ["k"], F.col("i"), "left_anti", where=cond, parts=4, least=20)) == rows(plain.select(*left.columns))


def test_salted_join_with_a_key_named_count(spark, rows):
    left = skewed(spark).withColumnRenamed("k", "count")
    right = spark.createDataFrame([("hot", 7)], "count string, w long")
    assert salted_join(left, right, ["count"], F.col("i"), "inner", parts=4, least=20).count() == left.filter("count = 'hot'").count()


def test_spread_rank_equals_rank_with_ties(spark, rows):
    df = skewed(spark)
    want = rows(spread_rank(df, ["k"], "v"))
    assert rows(spread_rank(df, ["k"], "v", parts=4, least=20)) == want
    one = df.withColumn("v", F.lit(1.0))
    assert {r.place for r in spread_rank(one, ["k"], "v", parts=4, least=20).collect()} == {1}
    assert rows(spread_rank(df.limit(0), ["k"], "v")) == []
