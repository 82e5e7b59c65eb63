"""Joins on keys of which a few may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A key is hot above this many rows and above a ``SHARE``-th of all rows: there are fewer than ``SHARE`` hot keys.
HOT_ROWS, SHARE = 100_000, 1000


def hot_keys(rows: DataFrame, keys: str | Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows and a thousandth of all rows (under a thousand keys), written once; None if there are none."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    if counts.isEmpty():
        return None
    return cut_lineage(counts.where(F.col("_rows") > rows.count() // SHARE).select(*keys))


def join_on_key(rows: DataFrame, table: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a table of a few rows for each key.

    The hot keys' rows stay where they are: their part of the table, bounded by the number of
    hot keys, is broadcast. All other keys are joined as Spark chooses.
    """
    return _join(rows, table, [key], hot_rows, "inner")


def left_join_on_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` (no key of theirs null) with a table of a few rows for each key; hot keys as in ``join_on_key``."""
    return _join(rows, table, list(keys), hot_rows, "left")


def _join(rows: DataFrame, table: DataFrame, keys: list[str], hot_rows: int, how: str) -> DataFrame:
    hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.join(table, keys, how)
    of_hot = cut_lineage(table.join(F.broadcast(hot), keys, "left_semi"))
    marked = F.broadcast(hot.join(of_hot, keys, "left"))  # every hot key, with its part of the table or nulls
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(of_hot) if how == "inner" else marked, keys).unionByName(rest)
