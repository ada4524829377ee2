from pyspark.sql import functions as F

from tipscope.operators.latest import latest_version, one_per_key
from tipscope.operators.skew import hot_keys, key_counts, skew_join


def sides(spark):
    big = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    small = spark.createDataFrame(
        [("hot", 1), *[(f"k{i}", i) for i in range(0, 3000, 7)], ("none", 9)],
        "key string, value int")
    return big, small


def test_same_rows_as_a_plain_join(spark):
    big, small = sides(spark)
    for how in ("left", "inner"):
        want = sorted(map(repr, big.join(small, "key", how).select("id", "key", "value").collect()))
        got = skew_join(big, small, "key", spread_by=["id"], how=how)
        assert sorted(map(repr, got.select("id", "key", "value").collect())) == want


def test_hot_rows_are_dealt_by_the_share_of_the_key(spark):
    big, small = sides(spark)
    hot = hot_keys(key_counts(big, "key"), "key").collect()
    keyed = big.where("key IS NOT NULL").count()
    assert [(r.key, r._salts) for r in hot] == [("hot", -(-1000 * 1000 // keyed))]
    every = hot_keys(key_counts(big.withColumn("key", F.lit("k")), "key"), "key").first()
    assert every._salts == 1000


def test_rows_without_a_key_go_around_the_join(spark):
    big, small = sides(spark)
    joined = skew_join(big, small, "key", spread_by=["id"])
    halves = joined._jdf.queryExecution().analyzed().children()
    assert joined._jdf.queryExecution().analyzed().nodeName() == "Union"
    assert "Join" in halves.apply(0).toString() and "Join" not in halves.apply(1).toString()


def test_number_of_hot_keys_is_bounded(spark):
    even = spark.range(10000).select((F.col("id") % 5000).cast("string").alias("key"))
    assert hot_keys(key_counts(even, "key"), "key").count() == 0
    few = spark.range(10000).select((F.col("id") % 10).cast("string").alias("key"))
    assert hot_keys(key_counts(few, "key"), "key").count() == 10


def test_one_row_per_key_with_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 2, "b"), ("a", 1, "z"), ("b", None, "q")],
                               "k string, s int, v string")
    got = {r.k: r.v for r in latest_version(df, ["k"], "s").collect()}
    assert got == {"a": "x", "b": "q"}
    first = one_per_key(df, ["k"], [F.col("s").alias("o1"), F.col("v").alias("o2")])
    assert {r.k: r.v for r in first.collect()} == {"a": "z", "b": "q"}
    assert first.columns == df.columns
