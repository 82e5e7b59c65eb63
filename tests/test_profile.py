import numpy as np
import pytest

from tabwise.operators import profile
from tabwise.operators.quantiles import exact_quantiles

ROWS = [(1.0, 1.0, "A"), (2.0, 2.5, "B"), (3.0, 3.0, "A"), (None, 4.0, "B"), (5.0, None, "A"), (100.0, 6.0, "A")]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "feature1 DOUBLE, feature2 DOUBLE, label STRING")


def test_missing(frame):
    got = {r.column_name: r.n_missing for r in profile.missing_counts(frame).collect()}
    assert got == {"feature1": 1, "feature2": 1}


def test_outliers_and_fences(frame):
    rows = {r.column_name: r for r in profile.outlier_counts(frame, ["feature1", "feature2"]).collect()}
    assert rows["feature1"].n_outliers == 1 and rows["feature2"].n_outliers == 0
    assert (rows["feature1"].q1, rows["feature1"].q3) == (2.0, 5.0)
    assert (rows["feature1"].lower, rows["feature1"].upper) == (-2.5, 9.5)
    assert (rows["feature2"].q1, rows["feature2"].q3) == (2.5, 4.0)


def test_box_stats_whiskers(frame):
    r = {x.column_name: x for x in profile.box_stats(frame, ["feature1"]).collect()}["feature1"]
    assert (r.median, r.whisker_low, r.whisker_high) == (3.0, 1.0, 5.0)


def test_class_counts_and_duplicates(frame):
    assert [(r.label, r.n) for r in profile.class_counts(frame, "label").collect()] == [("A", 4), ("B", 2)]
    assert profile.duplicate_count(frame).collect()[0].n_duplicates == 0


def test_duplicates_null_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x")], "a INT, b STRING")
    assert profile.duplicate_count(df).collect()[0].n_duplicates == 3


def test_correlation_pairwise_and_constant(spark, frame):
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation(frame, ["feature1", "feature2"]).collect()}
    assert round(got[("feature1", "feature2")], 6) == 0.920529
    const = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a DOUBLE, c DOUBLE")
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation(const).collect()}
    assert got[("a", "c")] is None
    assert profile.correlation(const.select("a")) is None


def test_exact_quantiles_with_a_hot_value(spark):
    # a third of all rows share one value; the bracket step must stay exact
    vals = [7.0] * 400 + [float(i) for i in range(800)]
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    got = {r.p: r.value for r in exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.99]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id INT, x DOUBLE")
    b = spark.createDataFrame([(2, "s")], "id INT, y STRING")
    rows = sorted(profile.union_train_test(a, b).collect(), key=lambda r: r.id)
    assert rows[0].y is None and rows[1].x is None


def test_correlation_in_blocks_equals_one_pass(spark, monkeypatch):
    df = spark.range(50).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "cast(id * id % 11 as double) c", "if(id % 3 = 0, null, 1.5) d")
    whole = sorted((r.col_a, r.col_b, r["corr"] is None or round(r["corr"], 9)) for r in profile.correlation(df).collect())
    monkeypatch.setattr(profile, "PAIRS_A_PASS", 3)
    assert whole == sorted((r.col_a, r.col_b, r["corr"] is None or round(r["corr"], 9)) for r in profile.correlation(df).collect())
    assert len(whole) == 16


def test_duplicates_compare_whole_rows_of_repeated_fingerprints(spark):
    from pyspark.sql import functions as F

    rows = [(None, 1.0, "a"), (1, None, "a"), (None, 1.0, "a"), (1, 0.0, "b"), (1, -0.0, "b"), (2, float("nan"), None), (2, float("nan"), None), (3, 3.0, "")] + [(7, 7.0, "hot")] * 50
    df = spark.createDataFrame(rows, "`a.b` INT, x DOUBLE, s STRING")
    assert profile.duplicate_count(df).first().n_duplicates == 1 + 1 + 1 + 49
    assert profile.duplicate_count(df, ["s"]).first().n_duplicates == len(rows) - 5
    assert profile.duplicate_count(df.where(F.lit(False))).first().n_duplicates == 0
    assert profile.duplicate_count(df.limit(2)).first().n_duplicates == 0
