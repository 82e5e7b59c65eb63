import pytest
from pyspark.sql import functions as F

from tabwise.operators import skew


@pytest.mark.parametrize("hot_rows", [5, 100_000])
def test_joins_with_hot_keys_equal_plain_joins(spark, hot_rows):
    rows = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), (F.col("id") % 2).alias("k2"))
    table = spark.createDataFrame([("hot", 0, "a"), ("hot", 1, "b"), ("k1", 0, "c"), ("k5", 1, "d"), ("k7", 0, "e"), ("k7", 0, "f")], "key STRING, k2 LONG, v STRING")
    assert (skew.hot_keys(rows, "key", 5) is None) is False and skew.hot_keys(rows, "key") is None
    got = skew.join_on_key(rows, table.select("key", "v"), "key", hot_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table.select("key", "v"), "key").collect()))
    left = skew.left_join_on_keys(rows, table, ["key", "k2"], hot_rows).select("id", "key", "k2", "v")
    want = rows.join(table, ["key", "k2"], "left").select("id", "key", "k2", "v")
    order = lambda df: sorted(map(str, df.collect()))
    assert order(left) == order(want)
