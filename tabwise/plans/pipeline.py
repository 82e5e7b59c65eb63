"""End-to-end workflow in the reference's order:

load -> drop columns -> stratified split -> count sources -> locate through
the cache -> ordinal encode (fit on train) -> select features -> tune ->
validate -> build -> evaluate.

Everything stays a DataFrame; the prepared train / test frames are written
once (to the shared checkpoint folder) before the learners scan them
repeatedly, so a lost executor re-reads them instead of recomputing the
whole preparation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, encode, learn, locate, metrics, search, select, split
from ..session import cut_lineage


@dataclass
class PipelineConfig:
    label_col: str
    id_cols: list[str]
    drop_cols: list[str] = field(default_factory=list)
    sources_col: str | None = None
    lat_col: str | None = None
    lon_col: str | None = None
    encode_cols: list[str] = field(default_factory=list)
    test_size: float = 0.2
    seed: int = 42
    algo: str = "xgb"
    top_n: int | None = None
    importance_threshold: float = 0.0
    tune_trials: tuple[int, int] = (2, 2)
    tune_bounds: dict | None = None
    cv_splits: int = 5
    validation_splits: int = 10
    imputer_strategy: str | None = "median"
    scaler: str | None = "robust"
    resample: str | None = None
    model_params: dict | None = None


@dataclass
class PipelineResult:
    selected: list[str]
    best_params: dict
    fold_table: DataFrame
    report: DataFrame
    confusion: DataFrame
    auc_train: DataFrame | None
    auc_test: DataFrame | None
    roc_train: DataFrame | None
    roc_test: DataFrame | None
    model: learn.BuiltModel


def prepare(df: DataFrame, cfg: PipelineConfig, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stages 2-6: one lazy plan per split, then a lineage cut."""
    data = clean.drop_columns(df, cfg.drop_cols) if cfg.drop_cols else df
    parts = split.stratified_split(data, cfg.label_col, cfg.id_cols, cfg.test_size, cfg.seed)
    if cfg.sources_col:
        parts = clean.count_sources(parts, cfg.sources_col)
    if cfg.lat_col and cfg.lon_col and cache is not None:
        parts = locate.enrich_location(parts, cache, lat_col=cfg.lat_col, lon_col=cfg.lon_col)
    train = parts.where(F.col("split") == "train").drop("split")
    test = parts.where(F.col("split") == "test").drop("split")
    if cfg.encode_cols:
        train, test, _ = encode.encode(train, cfg.encode_cols, test)
    return cut_lineage(train), cut_lineage(test)


def run_pipeline(df: DataFrame, cfg: PipelineConfig, cache: DataFrame | None = None) -> PipelineResult:
    train, test = prepare(df, cfg, cache)
    features = [c for c in train.columns if c not in (cfg.label_col, *cfg.id_cols)]
    _, chosen, _, _, _ = select.select_features(train, cfg.label_col, features, cfg.algo, cfg.top_n,
                                                cfg.importance_threshold, model_params=cfg.model_params,
                                                seed=cfg.seed)
    cols = [*cfg.id_cols, *chosen, cfg.label_col]
    train_s, test_s = train.select(*cols), test.select(*cols)
    init, n_iter = cfg.tune_trials
    best, _ = search.tune(train_s, cfg.label_col, cfg.id_cols, chosen, cfg.algo, cfg.resample, cfg.scaler,
                          cfg.imputer_strategy, cfg.cv_splits, cfg.seed, init, n_iter, cfg.tune_bounds)
    folds = search.cross_validate(train_s, cfg.label_col, cfg.id_cols, chosen, cfg.algo, cfg.resample, cfg.scaler,
                                  cfg.imputer_strategy, cfg.validation_splits, cfg.seed, params=best)
    built = learn.build_model(train_s, cfg.label_col, chosen, model_type=cfg.algo, model_params=best,
                              imputer_strategy=cfg.imputer_strategy, scaler_type=cfg.scaler,
                              resample_type=cfg.resample, id_col=cfg.id_cols[0], seed=cfg.seed,
                              exclude=cfg.id_cols)
    return evaluate(built, train_s, test_s, cfg.label_col, chosen, folds, best)


def evaluate(built: learn.BuiltModel, train: DataFrame, test: DataFrame, label_col: str,
             selected: Sequence[str] = (), folds: DataFrame | None = None, best: dict | None = None) -> PipelineResult:
    """E1-E7 on the test split; ROC curve and AUC for train and test when the label is binary. Scored frames are written once."""
    ltype = test.schema[label_col].dataType
    s_test = cut_lineage(learn.score(built, test, keep=[label_col]).withColumn("prediction", F.col("prediction").cast(ltype)))
    curves = [None] * 4
    if built.n_classes == 2 and built.labels == [0, 1]:
        s_train = cut_lineage(learn.score(built, train, keep=[label_col]))
        curves = [*(metrics.auc(s, label_col, "prob_1") for s in (s_train, s_test)),
                  *(metrics.roc_points(s, label_col, "prob_1", drop_intermediate=True) for s in (s_train, s_test))]
    return PipelineResult(list(selected), best or {}, folds, metrics.report(s_test, label_col),
                          metrics.confusion(s_test, label_col), *curves, built)
