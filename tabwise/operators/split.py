"""Deterministic stratified split and k-fold assignment.

Rows are ordered inside their class by md5(seed | id), which any SQL engine
can reproduce. The within-class row number comes from ``rank_within``
(range-partitioned), so a class holding most of the rows is still spread
over many tasks. Class quotas are bounded constants (one per class).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rank_within

# Fixed defaults of the reference workflow.
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2


def _hash(seed: int, id_cols: Sequence[str]):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


# More distinct labels than this are no classes (an id or a number, most likely): an error, not a driver full of rows.
MAX_CLASSES = 1_000


def _class_counts(df: DataFrame, label_col: str) -> list[tuple[object, int]]:
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col!r} has over {MAX_CLASSES} distinct values; it is no class label")
    return sorted(((r[label_col], int(r["n"])) for r in rows), key=lambda t: (t[0] is None, t[0]))


def split_quotas(counts: Sequence[tuple[object, int]], test_size: float) -> dict:
    """Largest-remainder allocation of ceil(n * test_size) test rows over classes."""
    total = sum(n for _, n in counts)
    nt = math.ceil(test_size * total)
    base = {c: (n * nt) // total for c, n in counts}
    rem = sorted(counts, key=lambda t: (-((t[1] * nt) % total), counts.index(t)))
    left = nt - sum(base.values())
    for c, _ in rem[:left]:
        base[c] += 1
    return base


def _quota_table(df: DataFrame, label_col: str, values: dict, name: str) -> DataFrame:
    t = df.schema[label_col].dataType
    rows = [(k, int(v)) for k, v in values.items()]
    return df.sparkSession.createDataFrame(rows, f"_k {t.simpleString()}, {name} LONG")


def stratified_split(df: DataFrame, label_col: str, id_cols: Sequence[str], test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' for the first quota[class] rows of each class in hash order."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be between 0 and 1")
    ranked = rank_within(df.withColumn("_h", _hash(seed, id_cols)), label_col, ["_h", *id_cols], rank_col="_rn")
    counts = _class_counts(ranked, label_col)  # from the written copy
    quotas = _quota_table(df, label_col, split_quotas(counts, test_size), "_quota")
    out = ranked.join(F.broadcast(quotas), ranked[label_col].eqNullSafe(quotas["_k"]))
    out = out.withColumn(split_col, F.when(F.col("_rn") <= F.col("_quota"), "test").otherwise("train"))
    return out.select(*df.columns, split_col)


def train_test_split(df: DataFrame, label_col: str, id_cols: Sequence[str], test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, label_col, id_cols, test_size, seed)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def stratified_folds(df: DataFrame, label_col: str, id_cols: Sequence[str], k: int = 5, seed: int = DEFAULT_SEED,
                     fold_col: str = "fold") -> DataFrame:
    """R2: fold = (class offset + row number in class - 1) mod k, so every class is spread evenly."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = rank_within(df.withColumn("_h", _hash(seed, id_cols)), label_col, ["_h", *id_cols], rank_col="_rn")
    counts = _class_counts(ranked, label_col)  # from the written copy
    if all(n < k for _, n in counts):
        raise ValueError(f"k={k} is greater than the number of members in every class")
    offsets, run = {}, 0
    for c, n in counts:
        offsets[c] = run
        run += n
    offs = _quota_table(df, label_col, offsets, "_off")
    out = ranked.join(F.broadcast(offs), ranked[label_col].eqNullSafe(offs["_k"]))
    out = out.withColumn(fold_col, ((F.col("_off") + F.col("_rn") - 1) % k).cast("int"))
    return out.select(*df.columns, fold_col)
