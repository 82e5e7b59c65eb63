import pytest
from pyspark.sql import functions as F

from tabwise.operators import learn, prep, quantiles, search
from tabwise.operators.prep import PrepSpec


@pytest.fixture()
def folds(spark):
    h = lambda s, n: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(n))
    return spark.range(0, 997, 1, 4).select(
        (h("f", 5)).cast("int").alias("fold"), (h("a", 100_003) / 7.0).alias("many"), F.when(h("n", 3) > 0, h("b", 6)).cast("int").alias("few"),
        F.when(h("m", 10) > 6, h("c", 1000) / 3.0).alias("rare"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, 2.5).alias("one"),
        F.when(h("k", 4) > 0, 1.5).otherwise(h("d", 50) * 1.0).alias("hot"))


@pytest.mark.parametrize("imputer,scaler", [("median", "robust"), (None, "robust"), ("median", None)])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_constants_of_all_folds_are_those_of_each(folds, imputer, scaler, accuracy, monkeypatch):
    monkeypatch.setattr(quantiles.order_statistics_without, "__defaults__", (accuracy,))
    spec = PrepSpec(["many", "few", "rare", "none", "one", "hot"], [], imputer, scaler)
    got = prep.fold_constants(folds, "fold", 6, spec)  # fold 5 is empty
    for f in (0, 1, 2, 5):
        want = prep.fit_prep(folds.where(F.col("fold") != f).drop("fold"), spec)
        assert got[f] == (want.impute_values, want.scale_values)


def test_other_specs_are_fitted_by_fold(folds):
    for spec in (PrepSpec(), PrepSpec(["many"], [], "mean", "robust"), PrepSpec(["many"], [], None, None)):
        assert prep.fold_constants(folds, "fold", 5, spec) is None


def test_folds_are_read_together(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(prep, "quantile_map", lambda *a: calls.append(a))
    df = spark.range(200).select("id", (F.col("id") % 40 * 0.5).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id") % 7 * 1.0).alias("z"), (F.col("id") % 40 > 25).cast("int").alias("y"))
    table = search.cross_validate(df, "y", ["id"], ["x", "z"], "xgb", None, "robust", "median", cv_splits=4, params={"n_estimators": 3})
    assert not calls and table.count() == 4


def test_bins_of_few_and_many_values(spark):
    df = spark.range(4000).select((F.col("id") % 3 * 1.0).alias("a"), (F.col("id") % 256 * 1.0).alias("b"), (F.col("id") % 290 * 1.0).alias("c"), F.col("id").cast("double").alias("d"))
    cuts = learn.bin_cuts(df, ["a", "b", "c", "d"])
    assert cuts[0] == [0.5, 1.5] and cuts[1] == [i + 0.5 for i in range(255)]
    assert all(200 < len(c) < 256 and c == sorted(c) for c in cuts[2:])
