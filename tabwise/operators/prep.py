"""Feature preparation (T5-T10): imputation, robust scaling and the column
router, fitted into constants and persisted as a ``SQLTransformer`` stage.

Fitting computes bounded constants (one median / mean / mode / IQR per
column) with distributed aggregations; transforming is a projection that
stays in whole-stage codegen.
"""

from __future__ import annotations

import base64
import datetime
import decimal
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import quoted
from .quantiles import order_statistics_without, quantile_map
from .sketches import sketch_quantile_map

IMPUTERS = ("median", "mean", "most_frequent")
SCALERS = ("robust",)


def _lit_sql(v) -> str:
    """A constant as SQL text; strings go through base64, so no character of theirs is ever parsed."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"CAST(unbase64('{base64.b64encode(v.encode()).decode()}') AS STRING)"
    if isinstance(v, int):
        return f"CAST('{v}' AS BIGINT)"
    if isinstance(v, datetime.datetime):
        return f"CAST('{v.isoformat(sep=' ')}' AS TIMESTAMP_NTZ)"
    if isinstance(v, datetime.date):
        return f"CAST('{v.isoformat()}' AS DATE)"
    if isinstance(v, decimal.Decimal):
        return f"CAST('{v}' AS DECIMAL({max(len(v.as_tuple().digits), -v.as_tuple().exponent, 1)}, {max(0, -v.as_tuple().exponent)}))"
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def column_medians(df: DataFrame, cols: Sequence[str], sketches: DataFrame | None = None) -> dict[str, float | None]:
    """T5: exact medians, or those of merged ``sketches`` (then the data is not read)."""
    qm = quantile_map(df, cols, [0.5]) if sketches is None else sketch_quantile_map(sketches, cols, [0.5])
    return {c: qm[c].get(0.5) for c in cols}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(quoted(c).cast("double")).alias(c) for c in cols]).collect()[0]
    return {c: row[c] for c in cols}


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties -> smallest value.

    Long form (column, value) -> counts -> min over (-count, value): partial
    aggregation throughout, a hot value is one row after the map side.
    """
    out: dict[str, object] = {}
    groups: dict[str, list[str]] = {}
    for c in cols:  # every column keeps its own type: no value is rounded or parsed again
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for cs in groups.values():
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), quoted(c).alias("v")) for c in cs])).alias("_s")).select(
            "_s.*").where(F.col("v").isNotNull())
        counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column_name").agg(
            F.min(F.struct((-F.col("n")).alias("k"), F.col("v").alias("v"))).alias("b"))
        got = {r["column_name"]: r["b"]["v"] for r in best.collect()}
        for c in cs:
            out[c] = got.get(c)
    return out


def impute(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    return df.select(*[F.coalesce(quoted(c), F.lit(constants[c])).alias(c) if constants.get(c) is not None
                       else quoted(c) for c in df.columns])


def robust_constants(df: DataFrame, cols: Sequence[str], sketches: DataFrame | None = None) -> dict[str, tuple[float | None, float]]:
    """(median, IQR) per column, exact or of merged ``sketches``; an IQR of 0 is replaced by 1."""
    probs = [0.25, 0.5, 0.75]
    qm = quantile_map(df, cols, probs) if sketches is None else sketch_quantile_map(sketches, cols, probs)
    out = {}
    for c in cols:
        q1, med, q3 = qm[c].get(0.25), qm[c].get(0.5), qm[c].get(0.75)
        iqr = (q3 - q1) if q1 is not None else None
        out[c] = (med, 1.0 if not iqr else iqr)
    return out


def robust_scale(df: DataFrame, cols: Sequence[str], constants: dict | None = None) -> DataFrame:
    constants = constants or robust_constants(df, cols)
    return df.select(*[((quoted(c).cast("double") - F.lit(constants[c][0])) / F.lit(constants[c][1])).alias(c)
                       if c in constants and constants[c][0] is not None else quoted(c) for c in df.columns])


@dataclass
class PrepSpec:
    """Which columns are numeric / categorical and which steps apply."""
    numeric_features: list[str] = field(default_factory=list)
    category_cols: list[str] = field(default_factory=list)
    imputer_strategy: str | None = None
    scaler: str | None = None
    impute_categories: bool = True

    @classmethod
    def for_validate(cls, numeric_features, imputer_strategy, scaler):
        """Validation preprocesses only when all three are given, and then always robust-scales."""
        if numeric_features and imputer_strategy and scaler:
            return cls(list(numeric_features), [], imputer_strategy, "robust")
        return cls([], [], None, None)


@dataclass
class PrepModel:
    spec: PrepSpec
    impute_values: dict
    scale_values: dict
    category_values: dict
    output_columns: list[str]

    def _exprs(self, columns: Sequence[str]):
        exprs = {}
        for c in self.spec.numeric_features:
            e = f"`{c}`"
            if self.impute_values.get(c) is not None:
                e = f"coalesce(`{c}`, {_lit_sql(self.impute_values[c])})"
            if c in self.scale_values and self.scale_values[c][0] is not None:
                med, iqr = self.scale_values[c]
                e = f"(CAST({e} AS DOUBLE) - {_lit_sql(med)}) / {_lit_sql(iqr)}"
            exprs[c] = e
        for c in self.spec.category_cols:
            v = self.category_values.get(c)
            exprs[c] = f"coalesce(`{c}`, {_lit_sql(v)})" if v is not None else f"`{c}`"
        rest = [c for c in columns if c not in exprs]
        return exprs, rest

    def feature_stage(self, feature_cols: Sequence[str], fills: dict | None = None,
                      suffix: str = "__f", indicators: Sequence[str] = (), missing: str = "__missing") -> SQLTransformer:
        """Stage that keeps every input column and appends ``<feature><suffix>`` columns.

        ``fills`` holds a last-resort value per feature (used where a value is
        still missing after prep), so the stage works on frames with or
        without the label column. ``indicators`` get a 0/1 column that is 1 where
        the feature is missing.
        """
        exprs, _ = self._exprs(feature_cols)
        parts = []
        for c in feature_cols:
            e = exprs.get(c, f"`{c}`")
            if fills and fills.get(c) is not None:
                e = f"coalesce(CAST({e} AS DOUBLE), {_lit_sql(fills[c])})"
            parts.append(f"CAST({e} AS DOUBLE) AS `{c}{suffix}`")
        parts += [f"CAST({exprs.get(c, f'`{c}`')} IS NULL AS DOUBLE) AS `{c}{missing}{suffix}`" for c in indicators]
        return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")

    def statement(self, columns: Sequence[str]) -> str:
        exprs, rest = self._exprs(columns)
        parts = [f"{exprs[c]} AS `{c}`" for c in self.spec.numeric_features + self.spec.category_cols]
        parts += [f"`{c}`" for c in rest]
        return "SELECT " + ", ".join(parts) + " FROM __THIS__"

    def stage(self, columns: Sequence[str]) -> SQLTransformer:
        """A persistable pipeline stage holding the fitted constants."""
        return SQLTransformer(statement=self.statement(columns))

    def transform(self, df: DataFrame) -> DataFrame:
        """Output order: numeric, category, remainder (the router's order)."""
        return self.stage(df.columns).transform(df)


def fold_constants(folds: DataFrame, fold_col: str, k: int, spec: PrepSpec) -> list[tuple[dict, dict]] | None:
    """(fills, (median, IQR)) per column, of the rows outside each of ``k`` folds, read for all folds at once; None if the spec needs more than quantiles.

    A filled column is its values with the median once for each null: places among those are places among the values.
    """
    num, fill, scale = spec.numeric_features, spec.imputer_strategy == "median", spec.scaler == "robust"
    if not num or spec.category_cols or spec.imputer_strategy not in (None, "median") or spec.scaler not in (None, "robust") or not (fill or scale):
        return None

    def at(p: float, n: int) -> tuple[int, int, float]:
        r = p * (n - 1)
        return int(r // 1), min(int(r // 1) + 1, n - 1), r - r // 1

    def filled(place: int, n: int, nulls: int) -> int | None:
        """The place among the values; None: a fill."""
        low, _, part = at(0.5, n)
        first = low + 1 if part else low  # of the fills
        return place if place < first else place - nulls if place >= first + nulls else None

    def all_of(n: int, nulls: int) -> list[tuple[float, list[int | None], float]]:
        z = nulls if fill else 0
        asked = [(0.5, list(at(0.5, n)[:2]), at(0.5, n)[2])] if fill else []
        for p in (0.25, 0.5, 0.75) if scale else ():
            lo, hi, part = at(p, n + z)
            asked.append((p, [filled(q, n, z) for q in (lo, hi)], part))
        return asked
    groups = lambda n, nulls: [sorted({p for p in pair if p is not None}) for _, pair, _ in all_of(n, nulls)]
    out = []
    for found in order_statistics_without(folds, fold_col, k, num, groups):
        fills, scales = {}, {}
        for c, (n, nulls, values) in found.items():
            fills[c], scales[c] = None, (None, 1.0)
            if not n:
                continue
            got = []
            for _, pair, part in all_of(n, nulls):
                lo, hi = (fills[c] if p is None else values[p] for p in pair)
                got.append(lo if part == 0.0 else lo + (hi - lo) * part)
                if fill and fills[c] is None:
                    fills[c] = got[0]
            if scale:
                q1, med, q3 = got[-3:]
                scales[c] = med, (q3 - q1) or 1.0
        out.append((fills if fill else {}, scales if scale else {}))
    return out


def fit_prep(df: DataFrame, spec: PrepSpec, constants: tuple[dict, dict] | None = None) -> PrepModel:
    """The spec's constants of ``df``, or (of ``fold_constants``) given ones."""
    if spec.imputer_strategy not in (None, *IMPUTERS):
        raise ValueError(f"imputer_strategy must be one of {IMPUTERS}")
    if spec.scaler not in (None, *SCALERS):
        raise ValueError(f"scaler must be one of {SCALERS}")
    num = list(spec.numeric_features)
    impute_values: dict = {}
    if constants is not None:
        impute_values = constants[0]
    elif num and spec.imputer_strategy == "median":
        impute_values = column_medians(df, num)
    elif num and spec.imputer_strategy == "mean":
        impute_values = column_means(df, num)
    elif num and spec.imputer_strategy == "most_frequent":
        impute_values = column_modes(df, num)
    scale_values: dict = {}
    if constants is not None:
        scale_values = constants[1]
    elif num and spec.scaler == "robust":
        base = df.select(*[quoted(c) for c in num])
        base = impute(base, impute_values) if impute_values else base
        scale_values = robust_constants(base, num)
    category_values = column_modes(df, spec.category_cols) if spec.category_cols and spec.impute_categories else {}
    rest = [c for c in df.columns if c not in num and c not in spec.category_cols]
    return PrepModel(spec, impute_values, scale_values, category_values, num + list(spec.category_cols) + rest)
