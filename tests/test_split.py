import pytest

from tabwise.operators.split import stratified_folds, stratified_split, split_quotas


def _data(spark, n_a=70, n_b=25, n_c=5):
    rows = [(i, "a") for i in range(n_a)] + [(100 + i, "b") for i in range(n_b)] + [(200 + i, "c") for i in range(n_c)]
    return spark.createDataFrame(rows, "id LONG, y STRING")


def test_quotas_largest_remainder():
    q = split_quotas([("a", 70), ("b", 25), ("c", 5)], 0.2)
    assert q == {"a": 14, "b": 5, "c": 1} and sum(q.values()) == 20
    q = split_quotas([("a", 3), ("b", 3), ("c", 1)], 0.5)
    assert sum(q.values()) == 4


def test_split_sizes_and_determinism(spark):
    df = _data(spark)
    s1 = stratified_split(df, "y", ["id"], 0.2, 42)
    got = {(r.y, r.split): r["count"] for r in s1.groupBy("y", "split").count().collect()}
    assert got[("a", "test")] == 14 and got[("b", "test")] == 5 and got[("c", "test")] == 1
    s2 = stratified_split(df, "y", ["id"], 0.2, 42)
    assert sorted(map(tuple, s1.collect())) == sorted(map(tuple, s2.collect()))
    s3 = stratified_split(df, "y", ["id"], 0.2, 7)
    assert sorted(map(tuple, s1.collect())) != sorted(map(tuple, s3.collect()))


def test_folds_spread_each_class(spark):
    f = stratified_folds(_data(spark), "y", ["id"], 5, 42)
    sizes = {r.fold: r["count"] for r in f.groupBy("fold").count().collect()}
    assert sorted(sizes.values()) == [20] * 5
    per = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(per[("a", k)] == 14 for k in range(5))


def test_folds_too_many(spark):
    with pytest.raises(ValueError):
        stratified_folds(_data(spark, 3, 3, 3), "y", ["id"], 5, 42)


def test_split_shuffles_once_before_its_write(spark):
    """The ranked copy is made by one range exchange; nothing hashes the rows again."""
    from pyspark.sql import functions as F

    from tabwise.operators import ranking
    plans = []
    real = ranking.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    ranking.cut_lineage = spy
    try:
        out = ranking.rank_within(spark.range(100).select("id", (F.col("id") % 3).alias("g")), "g", ["id"])
        assert {(r.g, r._rn) for r in out.collect()} == {(i % 3, i // 3 + 1) for i in range(100)}
    finally:
        ranking.cut_lineage = real
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
