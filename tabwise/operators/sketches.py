"""Mergeable quantile sketches: the large-data option of A3, A4, T5 and T8.

A KLL sketch of a column is a few kilobytes whatever it has seen, and two sketches merge into
the sketch of both inputs. So a table's sketches are kept by part (day, load, partition): new data adds
rows of its own, old data is not read again, and quantiles of any range of parts
come from merging its rows. Everything is Spark's own sketch aggregates.

The value returned for p has a rank of p times the count, give or take ``rank_error(k)`` of the
count, with 99 % confidence; missing values (NULL and NaN) are not counted. The exact path is ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import quoted

#: Size parameter: a rank error near 0.33 %, some 10 KB a sketch.
K = 800


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile at 99 % confidence (the published fit for KLL sketches)."""
    return 2.296 / k**0.9723


def sketch_parts(df: DataFrame, cols: Sequence[str], part: str | Column, k: int = K) -> DataFrame:
    """(part, column_name, sketch): one row for each part and column, in one aggregation."""
    part = quoted(part) if isinstance(part, str) else part
    value = lambda c: F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double"))
    found = df.groupBy(part.alias("part")).agg(*[F.kll_sketch_agg_double(value(c), k).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return found.select("part", F.explode(rows).alias("_s")).select("part", "_s.*")


def merge_parts(parts: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(*by, column_name, sketch): the sketches of many parts in one; ``by`` keeps groups of parts apart."""
    return parts.groupBy(*by, "column_name").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(..., column_name, p, n, value); a column without values gives NULL."""
    n = F.kll_sketch_get_n_double("sketch")
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("value")) for p in probs])
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, n.alias("n"), F.explode(rows).alias("_q")).select(*keep, "_q.p", "n", "_q.value")


def sketch_quantile_map(sketches: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float | None]]:
    """As ``quantiles.quantile_map``, from merged sketches: a few numbers a column, no scan of the data."""
    out: dict[str, dict[float, float | None]] = {c: {} for c in cols}
    for r in sketch_quantiles(sketches.where(F.col("column_name").isin(list(cols))), probs).collect():
        out[r.column_name][float(r.p)] = r.value
    if missing := [c for c in cols if not out[c]]:
        raise ValueError(f"no sketch of {missing}")
    return out
