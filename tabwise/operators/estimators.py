"""Encoding, preparation and learning as ``pyspark.ml`` estimators.

Each fitted model holds all it needs to work on raw rows: the encoder its mapping table, the
preparation its constants, the classifier its tree pipeline, labels and feature names. They are
stages like Spark's own, so ``Pipeline([OrdinalEncoder(...), TabularClassifier(...)])`` fits them together, and
the ``PipelineModel`` is one stored object: ``save`` writes every part below one path,
``PipelineModel.load`` gives it back, and ``transform`` scores raw categories.

Tables (mapping, labels) are stored as Parquet, Spark stages by their own writers, constants
as JSON text beside them.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, learn, prep


# --- storing a model with parts --------------------------------------------------------------------------------------

class _PartsWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"parts": self.instance._constants()})
        self.instance._save_tables(path)


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance._restore(self.sparkSession, path, metadata["parts"])
        return instance


class _StoredModel(Model, MLWritable, MLReadable):
    """A model whose ``_constants`` (JSON values) and ``_save_tables`` are all that ``_restore`` needs."""

    def write(self) -> MLWriter:
        return _PartsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader(cls)

    def _constants(self) -> dict:
        return {}

    def _save_tables(self, path: str) -> None:
        """Parts that are tables or Spark stages."""

    def _restore(self, spark: SparkSession, path: str, constants: dict) -> None:
        raise NotImplementedError


# --- ordinal encoder -------------------------------------------------------------------------------------------------

class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to encode, each replaced by its codes", typeConverter=TypeConverters.toListString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class OrdinalEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the categories of ``inputCols``."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> OrdinalEncoderModel:
        return self._copyValues(OrdinalEncoderModel(encode.fit_ordinal(dataset, self.getInputCols())))


class OrdinalEncoderModel(_StoredModel, _Columns):
    """Codes by the mapping table (column_name, category, code); an unseen category is -1."""

    def __init__(self, mapping: DataFrame | None = None):
        super().__init__()
        self.mapping = mapping

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode.transform_ordinal(dataset, self.mapping, self.getInputCols())

    def _save_tables(self, path: str) -> None:
        self.mapping.write.parquet(f"{path}/mapping")

    def _restore(self, spark: SparkSession, path: str, constants: dict) -> None:
        self.mapping = spark.read.parquet(f"{path}/mapping")


# --- imputation and scaling ------------------------------------------------------------------------------------------

class _PrepParams(Params):
    numericFeatures = Param(Params._dummy(), "numericFeatures", "columns to impute and scale", typeConverter=TypeConverters.toListString)
    categoryCols = Param(Params._dummy(), "categoryCols", "columns whose missing values become the most frequent one", typeConverter=TypeConverters.toListString)
    imputerStrategy = Param(Params._dummy(), "imputerStrategy", "median, mean, most_frequent or none", typeConverter=TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "robust or none", typeConverter=TypeConverters.toString)

    def _spec(self) -> prep.PrepSpec:
        none = lambda v: None if v == "none" else v
        return prep.PrepSpec(list(self.getOrDefault(self.numericFeatures)), list(self.getOrDefault(self.categoryCols)),
                             none(self.getOrDefault(self.imputerStrategy)), none(self.getOrDefault(self.scaler)))


class FeaturePrep(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the constants of imputation and robust scaling."""

    @keyword_only
    def __init__(self, *, numericFeatures=None, categoryCols=None, imputerStrategy="median", scaler="robust"):
        super().__init__()
        self._setDefault(numericFeatures=[], categoryCols=[], imputerStrategy="median", scaler="robust")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeaturePrepModel:
        return self._copyValues(FeaturePrepModel(prep.fit_prep(dataset, self._spec())))


class FeaturePrepModel(_StoredModel, _PrepParams):
    """The fitted constants as one projection; columns come out in the router's order."""

    def __init__(self, fitted: prep.PrepModel | None = None):
        super().__init__()
        self._setDefault(numericFeatures=[], categoryCols=[], imputerStrategy="median", scaler="robust")
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def _constants(self) -> dict:
        # Constants keep their types as SQL text: the same text that the projection is made of.
        as_sql = lambda values: {c: prep._lit_sql(v) for c, v in values.items()}
        return {"impute": as_sql(self.fitted.impute_values), "category": as_sql(self.fitted.category_values),
                "scale": {c: list(v) for c, v in self.fitted.scale_values.items()}, "columns": self.fitted.output_columns}

    def _restore(self, spark: SparkSession, path: str, constants: dict) -> None:
        texts = [(kind, c, sql) for kind in ("impute", "category") for c, sql in constants[kind].items()]
        row = spark.range(1).select(*[F.expr(sql).alias(f"v{i}") for i, (_, _, sql) in enumerate(texts)]).first() if texts else ()
        values = {"impute": {}, "category": {}}
        for (kind, c, _), v in zip(texts, row):
            values[kind][c] = v
        self.fitted = prep.PrepModel(self._spec(), values["impute"], {c: tuple(v) for c, v in constants["scale"].items()},
                                     values["category"], constants["columns"])


# --- classifier ------------------------------------------------------------------------------------------------------

class _LearnParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "the label, of any type", typeConverter=TypeConverters.toString)
    featureCols = Param(Params._dummy(), "featureCols", "the features, numbers or encoded", typeConverter=TypeConverters.toListString)
    modelType = Param(Params._dummy(), "modelType", "xgb or rf", typeConverter=TypeConverters.toString)
    modelParams = Param(Params._dummy(), "modelParams", "parameters of the learner, as JSON", typeConverter=TypeConverters.toString)
    imputerStrategy = Param(Params._dummy(), "imputerStrategy", "median or none", typeConverter=TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "robust or none", typeConverter=TypeConverters.toString)
    resampler = Param(Params._dummy(), "resampler", "smoteenn or none", typeConverter=TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id, needed by the resampler", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of resampling and learner", typeConverter=TypeConverters.toInt)

    def _value(self, name: str):
        v = self.getOrDefault(name)
        return None if v in ("none", "") else v


_LEARN_DEFAULTS = {"modelType": "xgb", "modelParams": "{}", "imputerStrategy": "none", "scaler": "none", "resampler": "none", "idCol": "",
                   "seed": learn.DEFAULT_SEED}


class TabularClassifier(Estimator, _LearnParams, DefaultParamsReadable, DefaultParamsWritable):
    """M6: preparation, optional resampling and the learner, on the columns of ``featureCols``."""

    @keyword_only
    def __init__(self, *, labelCol=None, featureCols=None, modelType="xgb", modelParams="{}", imputerStrategy="none", scaler="none",
                 resampler="none", idCol="", seed=learn.DEFAULT_SEED):
        super().__init__()
        self._setDefault(**_LEARN_DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TabularClassifierModel:
        label, features, row_id = self.getOrDefault("labelCol"), self.getOrDefault("featureCols"), self._value("idCol")
        rows = dataset.select(*features, label, *([row_id] if row_id and self._value("resampler") else []))
        built = learn.build_model(rows, label, features, model_type=self.getOrDefault("modelType"),
                                  model_params=json.loads(self.getOrDefault("modelParams")), imputer_strategy=self._value("imputerStrategy"),
                                  scaler_type=self._value("scaler"), resample_type=self._value("resampler"),
                                  id_col=row_id if self._value("resampler") else None, seed=self.getOrDefault("seed"))
        return self._copyValues(TabularClassifierModel(built))


class TabularClassifierModel(_StoredModel, _LearnParams):
    """M9: every input column, the prediction (the label itself) and the class probabilities."""

    def __init__(self, built: learn.BuiltModel | None = None):
        super().__init__()
        self._setDefault(**_LEARN_DEFAULTS)
        self.built = built

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return learn.score(self.built, dataset, keep=dataset.columns)

    def _constants(self) -> dict:
        return {k: getattr(self.built, k) for k in ("feature_cols", "label_col", "n_classes", "label_type", "inputs")}

    def _save_tables(self, path: str) -> None:
        self.built.model.save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        numbered = self.built.label_type if self.built.labels else "int"
        spark.createDataFrame(list(enumerate(self.built.labels or [])), f"place INT, label {numbered}").write.parquet(f"{path}/labels")

    def _restore(self, spark: SparkSession, path: str, constants: dict) -> None:
        labels = [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("place").collect()]
        self.built = learn.BuiltModel(PipelineModel.load(f"{path}/pipeline"), labels=labels or None, **constants)
