from pyspark.sql import functions as F

from tabwise.plans.pipeline import PipelineConfig, run_pipeline
from tabwise.sources import empty_cache, read_table, write_table


def test_run_pipeline_end_to_end(spark):
    df = spark.range(240).select(
        "id",
        F.concat_ws(",", F.lit("us"), F.when(F.col("id") % 2 == 0, F.lit("ak"))).alias("sources"),
        (F.col("id") % 7).cast("double").alias("mag"),
        (F.col("id") % 11).cast("double").alias("depth"),
        F.when(F.col("id") % 3 == 0, "mb").otherwise("ml").alias("magType"),
        F.lit("x").alias("unused"),
    ).withColumn("label", ((F.col("mag") + F.col("depth")) > 8).cast("int"))
    cfg = PipelineConfig(label_col="label", id_cols=["id"], drop_cols=["unused"], sources_col="sources",
                         encode_cols=["magType"], tune_trials=(1, 1), cv_splits=2,
                         tune_bounds={"n_estimators": (3, 5), "max_depth": (2, 3), "learning_rate": (0.2, 0.3),
                                      "min_child_weight": (1, 2)}, validation_splits=2)
    res = run_pipeline(df, cfg, empty_cache(spark))
    rep = {r.label: r for r in res.report.collect()}
    assert "accuracy" in rep and rep["accuracy"].support == 48
    assert res.auc_test.collect()[0].auc is not None
    assert res.fold_table.count() == 2 and set(res.best_params) >= {"n_estimators", "max_depth"}


def test_suffix_io_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a INT, b DOUBLE")
    for suffix in (".csv", ".json", ".parquet"):
        path = str(tmp_path / f"t{suffix}")
        write_table(df, path)
        back = read_table(spark, path)
        assert back.count() == 2 and back.where(F.col("b").isNull()).count() == 1
    try:
        write_table(df, str(tmp_path / "t.xlsx"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
