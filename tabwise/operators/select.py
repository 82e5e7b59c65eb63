"""Importance-based feature selection (M5, O1-O3, P10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import write_table
from .learn import build_model, check_model_type, feature_importance


def importance_sorted(imp: DataFrame) -> DataFrame:
    """O1: most important first; ties by feature name (explicit, deterministic)."""
    return imp.orderBy(F.desc("importance"), F.asc("feature"))


def importance_top_n(imp: DataFrame, n: int) -> DataFrame:
    """O2: the n most important features (a top-n, not a full sort)."""
    return importance_sorted(imp).limit(n)


def importance_threshold(imp: DataFrame, threshold: float = 0.0) -> DataFrame:
    """O3: features with importance strictly above the threshold."""
    return imp.where(F.col("importance") > F.lit(threshold))


def selected_features(imp: DataFrame, top_n: int | None = None, threshold: float = 0.0) -> list[str]:
    """``top_n`` wins over the threshold (the list is bounded by the feature count)."""
    chosen = importance_top_n(imp, top_n) if top_n is not None else importance_sorted(
        importance_threshold(imp, threshold))
    return [r["feature"] for r in chosen.collect()]


def select_features(train: DataFrame, label_col: str, feature_cols: Sequence[str], algo: str = "xgb",
                    top_n: int | None = None, importance_threshold: float = 0.0, test: DataFrame | None = None,
                    model_params: dict | None = None, seed: int = 42, save_path: str | None = None):
    """M5: fit a learner, rank importances, keep the selection on train (and test, if given).

    ``save_path`` writes the selected training frame (K4), its format by suffix.

    Returns (model, selected, train_selected, test_selected, importance table).
    """
    check_model_type(algo)
    built = build_model(train.select(*feature_cols, label_col), label_col, list(feature_cols), model_type=algo,
                        model_params=model_params, seed=seed)
    imp = feature_importance(built)
    chosen = selected_features(imp, top_n, importance_threshold)
    train_sel = train.select(*chosen, label_col)
    test_sel = test.select(*chosen, *[c for c in [label_col] if c in test.columns]) if test is not None else None
    if save_path:
        write_table(train_sel, save_path)
    return built, chosen, train_sel, test_sel, importance_sorted(imp)
