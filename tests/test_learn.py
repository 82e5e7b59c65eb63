import json

import pytest
from pyspark.sql import functions as F

from tabwise.operators import learn, search, select
from tabwise.operators.prep import PrepSpec, fit_prep


def _synthetic(spark, n=200):
    # 4 features, the first two informative (hash-derived, deterministic)
    df = spark.range(n).select(
        F.col("id"),
        *[((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(j)), F.col("id").cast("string"))), 1, 6), 16, 10)
            .cast("double") / 16 ** 6) * 2 - 1).alias(f"num{j}") for j in range(1, 5)])
    return df.withColumn("label", ((F.col("num1") + 0.5 * F.col("num2")) > 0).cast("int"))


def test_build_and_score_xgb(spark):
    df = _synthetic(spark)
    built = learn.build_model(df, "label", ["num1", "num2", "num3", "num4"], model_type="xgb",
                              model_params={"n_estimators": 10, "max_depth": 3}, exclude=["id"])
    out = learn.score(built, df, keep=["label"])
    acc = out.select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).collect()[0][0]
    assert acc > 0.9 and "prob_1" in out.columns


def test_build_rf_with_prep_and_resampling(spark, tmp_path):
    df = _synthetic(spark).withColumn("num3", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("num3")))
    built = learn.build_model(df, "label", ["num1", "num2", "num3", "num4"], model_type="rf",
                              model_params={"n_estimators": 5, "max_depth": 4}, imputer_strategy="median",
                              scaler_type="robust", resample_type="smoteenn", id_col="id",
                              save_path=str(tmp_path / "m"))
    assert learn.score(built, df.drop("label")).count() == 200


def test_bad_arguments(spark):
    df = _synthetic(spark, 20)
    with pytest.raises(ValueError):
        learn.build_model(df, "label", ["num1"], model_type="svm")
    with pytest.raises(ValueError):
        learn.build_model(df, "label", ["num1"], model_type="xgb", resample_type="smote")


def test_params_file_overlay(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"n_estimators": 3, "max_depth": 2}))
    df = _synthetic(spark, 60)
    built = learn.build_model(df, "label", ["num1", "num2"], model_type="xgb", best_param_path=str(p),
                              model_params={"max_depth": 3}, exclude=["id", "num3", "num4"])
    gbt = built.model.stages[-1]
    assert gbt.getNumTrees == 3 and gbt.getOrDefault("maxDepth") == 3


def test_selection_top_n_and_threshold(spark):
    df = _synthetic(spark)
    _, chosen, train_sel, _, imp = select.select_features(df.drop("id"), "label", ["num1", "num2", "num3", "num4"],
                                                          top_n=2, model_params={"n_estimators": 10})
    assert set(chosen) == {"num1", "num2"} and train_sel.columns == [*chosen, "label"]
    above = select.selected_features(imp, None, 0.0)
    assert "num1" in above


def test_candidates_within_bounds(spark):
    c = search.candidates(spark, 30, search.DEFAULT_BOUNDS["xgb"], 42).collect()
    assert len(c) == 30
    for r in c:
        assert 0.01 <= r.learning_rate <= 0.3 and 3 <= r.max_depth < 10 and isinstance(r.n_estimators, int)


def test_cross_validate_and_tune(spark):
    df = _synthetic(spark, 120)
    t = search.cross_validate(df, "label", ["id"], ["num1", "num2", "num3", "num4"], "xgb", None, "robust",
                              "median", cv_splits=3, params={"n_estimators": 5, "max_depth": 3})
    rows = t.collect()
    assert [r.fold for r in sorted(rows, key=lambda r: r.fold)] == [1, 2, 3]
    assert set(t.columns) == {"fold", "macro_f1", "F1_0", "F1_1"}
    best, trials = search.tune(df, "label", ["id"], ["num1", "num2", "num3", "num4"], "xgb", cv_splits=2,
                               init_points=1, n_iter=1,
                               bounds={"n_estimators": (3, 6), "max_depth": (2, 4), "learning_rate": (0.1, 0.3),
                                       "min_child_weight": (1, 3)})
    assert trials.count() == 2 and isinstance(best["n_estimators"], int)


def test_validate_gate():
    assert PrepSpec.for_validate(["a"], "median", None).numeric_features == []
    assert PrepSpec.for_validate(["a"], "mean", "anything").scaler == "robust"


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (3.0,), (None,)], "x DOUBLE")
    m = fit_prep(df, PrepSpec(["x"], [], "most_frequent"))
    assert m.impute_values["x"] == 1.0


def test_unencoded_category_refused(spark):
    df = _synthetic(spark, 20).withColumn("cat", F.lit("x"))
    with pytest.raises(ValueError, match="cat"):
        learn.build_model(df, "label", ["num1"], model_type="xgb", exclude=["id"])


def test_checkpoint_dir_comes_from_session(spark):
    from tabwise.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d


def test_text_labels_and_class_probabilities(spark):
    df = _synthetic(spark).withColumn("kind", F.when(F.col("num1") > 0.3, "up").when(F.col("num1") < -0.3, "down").otherwise("flat")).drop("label")
    for algo in ("rf", "xgb"):
        built = learn.build_model(df, "kind", ["num1", "num2", "num3", "num4"], model_type=algo, model_params={"n_estimators": 5, "max_depth": 4}, exclude=["id"])
        out = learn.score(built, df, keep=["kind"])
        assert out.columns == ["kind", "prediction", "prob_down", "prob_flat", "prob_up"]
        row = out.agg(F.avg((F.col("kind") == F.col("prediction")).cast("double")).alias("hit"),
                      F.max(F.abs(F.col("prob_down") + F.col("prob_flat") + F.col("prob_up") - 1)).alias("off")).first()
        assert row.hit > 0.9 and row.off < 1e-9


def test_missing_indicator_is_a_feature(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("noise"), F.when(F.col("id") % 2 == 0, 5.0).alias("x"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    built = learn.build_model(df, "label", ["noise", "x"], model_type="rf", model_params={"n_estimators": 5, "max_depth": 3}, exclude=["id"])
    assert "x__missing__f" in built.inputs and {r.feature for r in learn.feature_importance(built).collect()} == {"noise", "x"}
    assert learn.score(built, df, keep=["label"]).where("label <> prediction").count() == 0


def test_prep_runs_once_per_fold(spark, monkeypatch):
    fits = []
    real = learn.fit_prep
    monkeypatch.setattr(learn, "fit_prep", lambda *a: fits.append(1) or real(*a))
    df = _synthetic(spark, 60)
    search.tune(df, "label", ["id"], ["num1", "num2", "num3", "num4"], "rf", cv_splits=2, init_points=2, n_iter=1,
                bounds={"n_estimators": (1, 3), "max_depth": (2, 3)})
    assert len(fits) == 2


def test_a_continuous_label_is_refused(spark):
    df = spark.range(1500).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("string").alias("label"))
    with pytest.raises(ValueError, match="distinct"):
        learn.build_model(df, "label", ["x"], model_type="rf", exclude=["id"])


class _Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["cv_fold_f1", "cv_fold_f1_noisy", "train_text_labels", "feature_importance", "select_features",
                                  "score_batch", "pipeline_report"])
def test_queries_fit_the_default_rounds(spark, monkeypatch, name):
    from tabwise.plans import catalog

    def seen(algo, params=None, *a, **k):
        raise _Seen(learn.spark_params(algo, params or {})["maxIter"])
    monkeypatch.setattr(learn, "make_learner", seen)
    with pytest.raises(_Seen) as got:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert got.value.args == (100,)


@pytest.mark.parametrize("name", ["tune", "pipeline_report"])
def test_queries_search_the_stated_bounds(spark, monkeypatch, name):
    """The operator's own bounds but for the rounds (README: the default 50 to 1000 did not end in the driver's time); 2 uniform trials, then 2 proposals."""
    from tabwise.operators import select
    from tabwise.plans import catalog

    def seen(spark, n, bounds, *a):
        raise _Seen(n, bounds)
    monkeypatch.setattr(search, "candidates", seen)
    monkeypatch.setattr(select, "select_features", lambda *a, **k: (None, ["priority"], None, None, None))
    with pytest.raises(_Seen) as got:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args == (2, {**search.DEFAULT_BOUNDS["xgb"], "n_estimators": (50, 150)})


def test_forests_hold_node_numbers_that_fit_in_memory(spark):
    assert learn.holds_node_ids(12, 1_200_000, 100)  # the orders of 1 GB
    assert not learn.holds_node_ids(12, 7_200_000, 100) and not learn.holds_node_ids(12, 1_200_000, 100, fits=8)
    prepared = learn.prepare(_synthetic(spark), "label", ["num1", "num2", "num3", "num4"], exclude=["id"])
    assert (prepared.rows, prepared.fits) == (200, 1)
    params = {"n_estimators": 5, "max_depth": 6}
    fitted = learn.fit_prepared(prepared, "rf", params).model.stages[-1]
    plain = learn.make_learner("rf", params, 2, learn.DEFAULT_SEED, "features", "_label").fit(prepared.train)
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert fitted.getCacheNodeIds() and not plain.getCacheNodeIds()
    assert trees(fitted) == trees(plain)
