"""Projections, guards and cleaning steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import count_sources_expr, count_sources_scoring_expr, safe_float, stringify
from .profile import string_columns


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """ValueError naming the first absent column."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"column '{c}' not found in DataFrame")


def feature_target_select(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features plus one target that is not among them."""
    if target in features:
        raise ValueError(f"target '{target}' is also a feature")
    require_columns(df, [*features, target])
    return df.select(*features, target)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; every named column must exist (Spark's drop would ignore it)."""
    require_columns(df, cols)
    return df.drop(*cols)


def stringify_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String columns cast to text, missing -> 'nan'."""
    cols = set(cols or string_columns(df))
    return df.select(*[stringify(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def ensure_column(df: DataFrame, col: str, dtype: str = "string") -> DataFrame:
    """P5: add an all-NULL column when absent."""
    return df if col in df.columns else df.withColumn(col, F.lit(None).cast(dtype))


def unencoded_guard(df: DataFrame, exclude: Sequence[str] = ()) -> None:
    """Refuse to train / select while string columns remain."""
    left = [c for c in string_columns(df) if c not in exclude]
    if left:
        raise ValueError(f"encode these category columns first: {left}")


def project_selected(df: DataFrame, selected: Sequence[str]) -> DataFrame:
    """P10: keep the selected features, in the given order."""
    require_columns(df, selected)
    return df.select(*selected)


def sanitise_negative(df: DataFrame, col: str, replacement: float) -> DataFrame:
    """A negative value is replaced (by a training median computed by the caller)."""
    x = F.col(col)
    return df.withColumn(col, F.when(x < 0, F.lit(replacement)).otherwise(x))


def parse_float(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double, unparsable -> NULL."""
    return df.select(*[safe_float(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def head_preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows by a stable order (a top-n, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def count_sources(df: DataFrame, column_name: str, out_col: str = "source_counter") -> DataFrame:
    """replace a comma-list column by its item count (appended last)."""
    require_columns(df, [column_name])
    return df.withColumn(out_col, count_sources_expr(column_name)).drop(column_name)


def count_sources_scoring(df: DataFrame, column_name: str, out_col: str = "source_counter") -> DataFrame:
    """scoring variant, blank text -> NULL count."""
    require_columns(df, [column_name])
    return df.withColumn(out_col, count_sources_scoring_expr(column_name)).drop(column_name)


def numeric_types_only(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
