"""Table profiling (A1-A9, U1): missing values, IQR outliers, box statistics,
class balance, pairwise correlation, duplicates, label universe.

Every statistic over many columns is one aggregation pass (partial
aggregation per task, a single-row final merge); only bounded constants
(quantile fences, one number per column) come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import quoted
from .gram import gram_correlation
from .quantiles import quantile_map
from .sketches import sketch_quantile_map

# Fixed value: Tukey fence multiplier used by the outlier rule.
IQR_FACTOR = 1.5
# Column pairs correlated in one aggregate; an aggregate of thousands would hold thousands of buffers.
PAIRS_A_PASS = 300

_STRICT64 = (T.LongType, T.DoubleType)


def numeric_columns(df: DataFrame, strict64: bool = False, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order; ``strict64`` keeps only 64-bit int / double."""
    kinds = _STRICT64 if strict64 else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    """String columns in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _unpivot_row(df: DataFrame, cols: Sequence[str], exprs, value_name: str, value_type: str) -> DataFrame:
    wide = df.agg(*[e.cast(value_type).alias(c) for c, e in zip(cols, exprs)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias(value_name)) for c in cols
    ])).alias("_s")).select("_s.column_name", f"_s.{value_name}")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: (column, n_missing) for columns with at least one missing value."""
    cols = list(cols or df.columns)
    exprs = [F.count(F.when(F.col(c).isNull(), 1)) for c in cols]
    return _unpivot_row(df, cols, exprs, "n_missing", "long").where(F.col("n_missing") > 0)


def missing_map(df: DataFrame, bucket: str | F.Column, cols: Sequence[str] | None = None) -> DataFrame:
    """A2 (re-aimed heat map): share of missing values per (row bucket, column)."""
    bcol = F.col(bucket) if isinstance(bucket, str) else bucket
    cols = [c for c in (cols or df.columns) if not (isinstance(bucket, str) and c == bucket)]
    agg = df.groupBy(bcol.alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return agg.select("bucket", "_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("m")) for c in cols])).alias("_s")).select(
        "bucket", "_s.column_name", (F.col("_s.m") / F.col("_n")).alias("missing_share"))


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = IQR_FACTOR, sketches: DataFrame | None = None) -> dict[str, tuple]:
    """Q1/median/Q3 and Tukey fences per column (bounded driver constants): exact, or of merged ``sketches`` (then the data is not read)."""
    probs = [0.25, 0.5, 0.75]
    qm = quantile_map(df, cols, probs) if sketches is None else sketch_quantile_map(sketches, cols, probs)
    out = {}
    for c in cols:
        q1, med, q3 = qm[c].get(0.25), qm[c].get(0.5), qm[c].get(0.75)
        if q1 is None:
            out[c] = (None, None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, med, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


def outlier_counts(df: DataFrame, cols: Sequence[str] | None = None, factor: float = IQR_FACTOR,
                   fences: dict[str, tuple] | None = None) -> DataFrame:
    """A3: rows strictly outside the Tukey fences per numeric column (nulls never count).

    ``fences``: of ``iqr_fences``, if they are known already.
    """
    cols = list(cols or numeric_columns(df))
    fences = fences or iqr_fences(df, cols, factor)
    exprs = []
    for c in cols:
        _, _, _, lo, hi = fences[c]
        x = F.col(c).cast("double")
        exprs.append(F.count(F.when((x < F.lit(lo)) | (x > F.lit(hi)), 1)) if lo is not None else F.lit(0))
    counts = {r["column_name"]: r["n_outliers"] for r in _unpivot_row(df, cols, exprs, "n_outliers", "long").collect()}
    rows = [(c, fences[c][0], fences[c][2], fences[c][3], fences[c][4], int(counts[c])) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column_name STRING, q1 DOUBLE, q3 DOUBLE, lower DOUBLE, upper DOUBLE, n_outliers LONG")


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, factor: float = IQR_FACTOR,
              fences: dict[str, tuple] | None = None) -> DataFrame:
    """A4: q1, median, q3 and whiskers (most extreme values inside the fences)."""
    cols = list(cols or numeric_columns(df))
    fences = fences or iqr_fences(df, cols, factor)
    aggs = []
    for c in cols:
        _, _, _, lo, hi = fences[c]
        x = F.col(c).cast("double")
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi)) if lo is not None else F.lit(False)
        aggs += [F.min(F.when(inside, x)).alias(f"lo__{c}"), F.max(F.when(inside, x)).alias(f"hi__{c}")]
    row = df.agg(*aggs).collect()[0]
    rows = [(c, fences[c][0], fences[c][1], fences[c][2], row[f"lo__{c}"], row[f"hi__{c}"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column_name STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE, whisker_low DOUBLE, whisker_high DOUBLE")


def class_counts(df: DataFrame, label_col: str) -> DataFrame:
    """A5: rows per non-null label, most frequent first."""
    return (df.where(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label_col)))


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame | None:
    """Pearson correlation matrix in long form (col_a, col_b, corr), pairwise-complete.

    Up to ``PAIRS_A_PASS`` pairs are one aggregate; more come from one Gram matrix over Arrow
    batches, so the table is scanned twice however wide it is. A constant column gives NULL (no
    division error under ANSI mode). Fewer than two numeric columns -> None.
    """
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return None
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return _correlate(df, pairs) if len(pairs) <= PAIRS_A_PASS else gram_correlation(df, cols)


def _correlate(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    aggs, entries = [], []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa = F.when(both, F.col(a).cast("double"))
        xb = F.when(both, F.col(b).cast("double"))
        aggs.append(F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb)).alias(f"r{k}"))
        for x, y in dict.fromkeys([(a, b), (b, a)]):
            entries.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"r{k}").alias("corr")))
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of identical rows (NULLs compare equal).

    Rows are first counted by a 128-bit fingerprint, so a table without repeats shuffles 16 bytes a
    row, not its rows. Only rows whose fingerprint occurs again are then compared whole.
    """
    cols = [quoted(c) for c in (cols or df.columns)]
    # Two hashes of 64 bits; NULLs are hashed by where they are, too.
    there = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    print_ = F.struct(F.xxhash64(*cols), F.xxhash64(there, *cols[::-1])).alias("_print")
    again = df.select(print_).groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_print")
    rows = df.select(print_, *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
    groups = rows.join(again, "_print", "left_semi").groupBy("_print", *[f"_c{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def label_universe(df: DataFrame, label_col: str) -> DataFrame:
    """Distinct non-null labels, sorted."""
    return df.select(label_col).where(F.col(label_col).isNotNull()).distinct().orderBy(label_col)


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack two frames by column name; missing columns are NULL-filled."""
    return train.unionByName(test, allowMissingColumns=True)


def eda_summary(df: DataFrame, label_col: str | None = None, numeric_cols: Sequence[str] | None = None,
                strict64: bool = False) -> dict:
    """The whole profile as a dict of DataFrames (lazy where possible); quartiles are computed once.

    The missing map is by input partition, the blocks in which the rows are stored.
    """
    num = list(numeric_cols or numeric_columns(df, strict64=strict64, exclude=[label_col] if label_col else []))
    fences = iqr_fences(df, num) if num else None
    return {
        "missing": missing_counts(df),
        "missing_map": missing_map(df, F.spark_partition_id()),
        "outlier_counts": outlier_counts(df, num, fences=fences) if num else None,
        "box_stats": box_stats(df, num, fences=fences) if num else None,
        "class_counts": class_counts(df, label_col) if label_col else None,
        "correlation": correlation(df, num),
        "duplicates": duplicate_count(df),
    }
