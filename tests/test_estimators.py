import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabwise.operators.estimators import FeaturePrep, FeaturePrepModel, OrdinalEncoder, TabularClassifier


def _rows(spark):
    rows = [(i, ["red", "green", None, "it's"][i % 4], float(i % 10) if i % 6 else None, "b" if i % 4 < 2 else "a") for i in range(160)]
    return spark.createDataFrame(rows, "id LONG, colour STRING, x DOUBLE, kind STRING")


def test_one_object_is_saved_loaded_and_scores_raw_rows(spark, tmp_path):
    df = _rows(spark)
    stages = [OrdinalEncoder(inputCols=["colour"]),
              TabularClassifier(labelCol="kind", featureCols=["colour", "x"], modelParams=json.dumps({"n_estimators": 5}), imputerStrategy="median", scaler="robust")]
    fitted = Pipeline(stages=stages).fit(df)
    path = f"file://{tmp_path}/model"
    fitted.save(path)
    loaded = PipelineModel.load(path)
    raw = df.drop("kind").unionByName(spark.createDataFrame([(900, "blue", None)], "id LONG, colour STRING, x DOUBLE"))
    got, want = ({r.id: r for r in m.transform(raw).collect()} for m in (loaded, fitted))
    assert got == want and {r.id: r.prediction for r in got.values() if r.id < 160} == {r.id: r.kind for r in df.collect()}
    assert set(got[900].asDict()) == {"id", "colour", "x", "prediction", "prob_1"} and got[900].colour == -1.0
    assert loaded.stages[1].getOrDefault("featureCols") == ["colour", "x"] and loaded.stages[0].mapping.count() == 4


def test_unfitted_stages_are_stored_too(spark, tmp_path):
    path = f"file://{tmp_path}/pipeline"
    Pipeline(stages=[OrdinalEncoder(inputCols=["colour"]), TabularClassifier(labelCol="kind", featureCols=["colour"], modelType="rf")]).save(path)
    stages = Pipeline.load(path).getStages()
    assert stages[0].getInputCols() == ["colour"] and stages[1].getOrDefault("modelType") == "rf"


def test_prepared_constants_keep_values_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "x'y", True), (2, None, "x'y", None), (None, 9.5, None, True), (2, 0.1, "é\\", False)], "n INT, x DOUBLE, s STRING, t BOOLEAN")
    for strategy, scaler in (("median", "robust"), ("most_frequent", "none"), ("mean", "none"), ("none", "none")):
        fitted = FeaturePrep(numericFeatures=["n", "x"], categoryCols=["s", "t"], imputerStrategy=strategy, scaler=scaler).fit(df)
        path = f"file://{tmp_path}/{strategy}"
        fitted.write().overwrite().save(path)
        again = FeaturePrepModel.load(path)
        a, b = fitted.transform(df), again.transform(df)
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert a.where(F.col("s").isNull()).count() == 0
