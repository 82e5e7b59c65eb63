"""Distributed global ordering: row numbers and running sums without a
single-partition window.

A plain ``Window.orderBy(...)`` (or ``partitionBy(class)`` when one class
holds most rows) runs in a single task. Here the rows are range-partitioned
on the ordering and sorted inside their partition -- one shuffle. The place in
the partition comes from ``monotonically_increasing_id`` (partition number in the
high bits, row number in the low ones), running sums from one streaming pass
over the sorted partition. The per-partition totals (one row per partition, a
bounded table) become offsets that are broadcast back.

The range boundaries come from a sample; two separately planned evaluations
could cut the ranges differently, so the locally ranked data is written once
with a reliable checkpoint (to ``spark.checkpoint.dir``) and both the totals
and the final rows read that same copy. The input is read twice, once for the
sample and once for the write, and never again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Groups of ``rank_within`` up to this many have their starts broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
_ROW_BITS = 33


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def global_cumulative(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str | Column] | None = None,
                      rank_col: str | None = "_rank", num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based global row number (``rank_col``) and inclusive running sums.

    ``order`` must make rows unique (add an id as tie-break) for the row number
    to be deterministic. ``sums`` maps output name -> expression; each output
    is the sum of the expression over all rows up to and including this one.
    """
    sums = dict(sums or {})
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    p = _n_parts(df, num_partitions)
    base = df
    for name, e in sums.items():
        base = base.withColumn(f"_v_{name}", F.col(e) if isinstance(e, str) else e)
        whole = isinstance(base.schema[f"_v_{name}"].dataType, T.IntegralType)
        base = base.withColumn(f"_v_{name}", F.col(f"_v_{name}").cast("long" if whole else "double"))
    local = base.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
    local = local.withColumn("_at", F.monotonically_increasing_id())
    local = local.withColumn("_pid", F.shiftright("_at", _ROW_BITS).cast("int")).withColumn(
        "_l_rank", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("_at")
    if sums:
        local = _running_sums(local, list(sums))
    local = cut_lineage(local)
    aggs = []
    if rank_col:
        aggs.append(F.count(F.lit(1)).alias("_t_rank"))
    for name in sums:
        aggs.append(F.sum(f"_v_{name}").alias(f"_t_{name}"))
    totals = local.groupBy("_pid").agg(*aggs)
    # One row per range partition: a bounded table, ordered by partition id.
    w_prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        "_pid",
        *([F.coalesce(F.sum("_t_rank").over(w_prev), F.lit(0)).alias("_o_rank")] if rank_col else []),
        *[F.coalesce(F.sum(f"_t_{n}").over(w_prev), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    out = local.join(F.broadcast(offs), "_pid")
    if rank_col:
        out = out.withColumn(rank_col, (F.col("_o_rank") + F.col("_l_rank")).cast("long"))
    for name in sums:
        out = out.withColumn(name, F.col(f"_o_{name}") + F.col(f"_l_{name}"))
    drop = ["_pid", "_l_rank", "_o_rank"] + [f"_{k}_{n}" for n in sums for k in ("v", "l", "o")]
    return out.drop(*drop)


def _running_sums(sorted_rows: DataFrame, names: list[str]) -> DataFrame:
    """``_l_<name>``: the sum of ``_v_<name>`` (NULL counts 0) up to each row of its sorted partition; batches are streamed."""
    schema = sorted_rows.schema
    schema = T.StructType([*schema.fields, *(T.StructField(f"_l_{name}", schema[f"_v_{name}"].dataType) for name in names)])

    def run(batches):
        before = dict.fromkeys(names, 0)
        for batch in batches:
            columns = list(batch.columns)
            for name in names:
                values = batch.column(f"_v_{name}").fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(np.concatenate([np.array([before[name]], values.dtype), values]))[1:]
                columns.append(pa.array(total))
                before[name] = total[-1] if len(total) else before[name]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"_l_{n}" for n in names)])

    return sorted_rows.mapInArrow(run, schema)


def rank_within(df: DataFrame, group_col: str, order: Sequence[str | Column], rank_col: str = "_rn",
                num_partitions: int | None = None) -> DataFrame:
    """1-based row number inside each ``group_col`` value, ordered by ``order``.

    Works when one group holds most rows: the global ordering (group, order)
    is range-partitioned, and the group's start offset comes from the small
    per-group count table.
    """
    ranked = global_cumulative(df, [F.col(group_col).asc_nulls_last(), *order], rank_col="_grank",
                               num_partitions=num_partitions)
    # starts and sizes come from the ranked copy, not from the input
    starts = ranked.groupBy(F.col(group_col).alias("_gk")).agg((F.min("_grank") - 1).alias("_gstart"), F.count(F.lit(1)).alias("_gn"))
    starts = F.broadcast(starts) if starts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else starts
    out = ranked.join(starts, ranked[group_col].eqNullSafe(F.col("_gk"))).drop("_gk")
    return out.withColumn(rank_col, (F.col("_grank") - F.col("_gstart")).cast("long")).drop("_grank", "_gstart")
