"""Ordinal encoding (T1-T4) with a mapping table instead of a fitted object.

fit:       (column, category, code) -- distinct train categories in ascending
           code-point order, 0-based, NULL is a category and sorts last.
transform: null-safe equi-join to the mapping; unseen -> -1.0.

Distinct categories are found with partial aggregation (a hot category is
one row after the map side); codes come from a range-partitioned global rank,
so a high-cardinality column never sorts in one task. The mapping is broadcast
when its counted size is small, and joined by a salted shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.readers import quoted
from .ranking import global_cumulative

# Fixed value: code given to categories not seen at fit time.
UNKNOWN_CODE = -1.0
METHODS = ("ordinal",)
# Categories of a column that are broadcast at most (a few MB); salts of the shuffle join beyond.
BROADCAST_CATEGORIES = 50_000
SALTS = 32


def fit_ordinal(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mapping table (column_name, category, code) for each column, in one pass over train.

    The table is written once: every use reads that copy.
    """
    cats = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("category")) for c in columns])).alias("_c")
    ).select("_c.*").distinct()
    # order: column, then category ascending (binary = code-point order) with NULL last
    cats = cats.withColumn("_nl", F.col("category").isNull().cast("int"))
    ranked = global_cumulative(cats, ["column_name", "_nl", "category"], rank_col="_g").drop("_nl")
    starts = ranked.groupBy("column_name").agg(F.min("_g").alias("_start"))  # a row for each column
    return cut_lineage(ranked.join(F.broadcast(starts), "column_name")
                       .select("column_name", "category", (F.col("_g") - F.col("_start")).cast("double").alias("code")))


def transform_ordinal(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its code; unseen (including an unseen NULL) -> -1.0.

    Up to ``BROADCAST_CATEGORIES`` categories of a column are broadcast. More are
    joined by shuffle on (category, salt) with the mapping repeated for every salt,
    so that a category of a third of the rows meets in SALTS tasks, not one.
    """
    sizes = {r["column_name"]: r["count"] for r in mapping.where(F.col("column_name").isin(list(columns))).groupBy("column_name").count().collect()}
    out = df
    for c in columns:
        m = mapping.where(F.col("column_name") == c).select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
        same = quoted(c).cast("string").eqNullSafe(F.col("_cat"))
        if sizes.get(c, 0) <= BROADCAST_CATEGORIES:
            out = out.join(F.broadcast(m), same, "left")
        else:
            out = out.withColumn("_salt", F.pmod(F.xxhash64(*[quoted(x) for x in df.columns]), F.lit(SALTS)).cast("int"))
            m = m.withColumn("_msalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = out.join(m, same & (F.col("_salt") == F.col("_msalt")), "left").drop("_salt", "_msalt")
        code = F.coalesce(F.col("_code"), F.lit(UNKNOWN_CODE))
        out = out.select(*[code.alias(x) if x == c else quoted(x) for x in df.columns])
    return out


def encode(train: DataFrame, columns: Sequence[str], test: DataFrame | None = None, method: str = "ordinal"):
    """Fit on train, apply to train and test; returns (train_enc, test_enc, mapping)."""
    if method not in METHODS:
        raise ValueError("encoding method must be 'ordinal'")
    mapping = fit_ordinal(train, columns)
    return (transform_ordinal(train, mapping, columns),
            transform_ordinal(test, mapping, columns) if test is not None else None,
            mapping)


def inspect_encoder(mapping: DataFrame, column: str) -> DataFrame:
    """T4: category -> code listing for one column."""
    return mapping.where(F.col("column_name") == column).select("category", "code").orderBy("code")
