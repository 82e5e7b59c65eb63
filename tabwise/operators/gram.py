"""Pairwise-complete Pearson correlation of many columns from one Gram matrix.

A first aggregation finds a shift for every column (its mean; its value if it has one
only). The second scan turns Arrow batches into matrices: Z holds the shifted values with 0 where
missing, M the presence (1 or 0). Over all rows the products

    n = M'M,  s = Z'M,  q = (Z*Z)'M,  c = Z'Z

give for every pair (a, b) the rows where both are present, the sums of a and of b over them,
their squares and their product: all a correlation needs. They add up over batches in the task
and over tasks by column pair, so the table is read once however many columns there are. A task
holds four matrices of columns x columns numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the squares about the shift below which a variance is rounding only.
ROUNDING = 1e-12
#: Rows that a task turns into a matrix at once, for this many numbers at most.
STEP_NUMBERS = 1 << 21

_SUMS = ("n", "s_a", "s_b", "q_a", "q_b", "c", "odd")


def _matrix(batch: pa.RecordBatch, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shifted values, presence, whether the value is no finite number) of a batch's columns."""
    present = np.column_stack([~np.asarray(c.is_null()) for c in batch.columns])
    values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
    odd = present & ~np.isfinite(values)
    return np.where(present & ~odd, values - shift, 0.0), present, odd


def _products(columns: int, shift: np.ndarray):
    """mapInArrow body: the task's sums as one row for each column pair a <= b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c, bad = (np.zeros((columns, columns)) for _ in range(5))
        step = max(1, STEP_NUMBERS // columns)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                z, present, odd = _matrix(batch.slice(i, step), shift)
                c += z.T @ z
                if present.all():  # every pair has all rows: sums of the columns do
                    n += len(z)
                    s += z.sum(axis=0)[:, None]
                    q += (z * z).sum(axis=0)[:, None]
                else:
                    m = present.astype(np.float64)
                    n += m.T @ m
                    s += z.T @ m
                    q += (z * z).T @ m
                if odd.any():
                    bad += odd.T.astype(np.float64) @ present
        a, b = np.triu_indices(columns)
        arrays = [a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], c[a, b], bad[a, b] + bad[b, a]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["a", "b", *_SUMS])
    return run


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, s_a, s_b, q_a, q_b, c, odd) for every pair of positions a <= b: sums of shifted values over the rows where both are present."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    finite = [F.when(~F.isnan(f"c{i}") & (F.abs(f"c{i}") != float("inf")), F.col(f"c{i}")) for i in range(len(cols))]
    row = numbers.agg(*[f(x) for f in (F.min, F.max, F.avg) for x in finite]).collect()[0]
    low, high, mean = (row[i * len(cols):(i + 1) * len(cols)] for i in range(3))
    shift = np.array([0.0 if m is None else lo if lo == hi else m for lo, hi, m in zip(low, high, mean)])
    sums = numbers.mapInArrow(_products(len(cols), shift), "a int, b int, " + ", ".join(f"{x} double" for x in _SUMS))
    # A table without rows has every pair, too.
    n = len(cols)
    none = df.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"),
                                               *[F.lit(0.0).alias(x) for x in _SUMS]).where("a <= b")
    return sums.unionByName(none).groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in _SUMS])


def gram_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) of all ordered pairs. A column that is constant over a pair's rows gives NULL, a NaN or infinite value there NaN."""
    def spread(q: str, s: str):
        v = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when(v > F.col(q) * ROUNDING, F.sqrt(v))

    both = F.try_divide(F.col("c") - F.col("s_a") * F.col("s_b") / F.col("n"), spread("q_a", "s_a") * spread("q_b", "s_b"))
    rounded = F.when(both.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both)))  # these two pass over NULL
    corr = F.when(F.col("n") > 0, F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(rounded))
    names = F.array(*[F.lit(c) for c in cols])
    name = lambda i: F.element_at(names, F.col(i) + 1)
    pairs = pair_sums(df, cols).select("a", "b", corr.alias("corr"))
    turned = F.array(*[F.struct(name(x).alias("col_a"), name(y).alias("col_b"), F.col("corr")) for x, y in (("a", "b"), ("b", "a"))])
    one = F.slice(turned, 1, 1)
    return pairs.select(F.explode(F.when(F.col("a") == F.col("b"), one).otherwise(turned)).alias("_e")).select("_e.*")
