"""Exact linear-interpolated quantiles that stay distributed.

Spark's exact ``percentile`` merges a value->count map of the whole column
in one task, which does not survive billions of distinct values. Here:

1. one pass: ``percentile_approx`` at p - d and p + d (a bracket around the
   target rank) and the non-null count, for every column at once;
2. one pass of plain counters: how many values lie below each bracket;
3. one pass: only values inside a bracket are exploded and reduced to
   (value, count) -- about 2·d·n of them, and a value that repeats (one hot value
   holding a third of the column) is one row;
4. a running count over the bracketed distinct values finds the two order
   statistics around rank p·(n-1); the value is ``lo + (hi - lo)·frac``.

The approximation's rank error is below n / accuracy and the bracket is three
times as wide, so it holds the rank. Should it miss all the same, the counters
tell, and the bracket grows by a small factor: the result is exact in all cases,
and the full range never goes through one task.
The result table has one row per (column, p): a bounded table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import quoted

#: A sketch holds about this many values of a column and partition, and one task merges those of all partitions; a
#: bracket holds 6 / _ACCURACY of the rows.
_ACCURACY = 10_000
_GROWTH = 4


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = _ACCURACY) -> DataFrame:
    """DataFrame(column STRING, p DOUBLE, n LONG, value DOUBLE) for every column and prob.

    Nulls are ignored; a column without values gives value NULL.
    """
    spark = df.sparkSession
    cols = list(dict.fromkeys(cols))
    pairs = [(c, float(p)) for c in cols for p in probs]
    x = {c: quoted(c).cast("double") for c in cols}
    results: dict[tuple[str, float], tuple[int, float | None]] = {}
    pending, delta = list(dict.fromkeys(pairs)), 3.0 / accuracy
    while pending:
        need = list(dict.fromkeys(c for c, _ in pending))
        grids = {c: sorted({q for d, p in pending if d == c for q in (max(0.0, p - delta), min(1.0, p + delta))}) for c in need}
        # Single rows of bounded constants (columns x probs), here and below.
        row = df.agg(*[e for i, c in enumerate(need) for e in (
            F.count(x[c]).alias(f"n{i}"), F.percentile_approx(x[c], grids[c], accuracy).alias(f"q{i}"))]).collect()[0]
        brackets = []
        for c, p in pending:
            i = need.index(c)
            n = int(row[f"n{i}"])
            if n == 0:
                results[(c, p)] = (0, None)
                continue
            at = dict(zip(grids[c], row[f"q{i}"]))
            lo = None if p - delta <= 0.0 else at[max(0.0, p - delta)]
            hi = None if p + delta >= 1.0 else at[min(1.0, p + delta)]
            brackets.append((c, p, n, lo, hi))
        if not brackets:
            break
        below = df.agg(*[(F.lit(0).cast("long") if lo is None else F.count(F.when(x[c] < F.lit(lo), 1))).alias(f"b{i}")
                         for i, (c, _, _, lo, _) in enumerate(brackets)]).collect()[0]

        def inside(c, lo, hi):
            ok = x[c].isNotNull()
            ok = ok if lo is None else ok & (x[c] >= F.lit(lo))
            return ok if hi is None else ok & (x[c] <= F.lit(hi))

        values = F.array_compact(F.array(*[F.when(inside(c, lo, hi), F.struct(F.lit(i).alias("i"), x[c].alias("v")))
                                           for i, (c, _, _, lo, hi) in enumerate(brackets)]))
        cells = (df.select(F.explode(values).alias("_s")).select("_s.i", "_s.v").groupBy("i", "v")
                 .agg(F.count(F.lit(1)).alias("c")))
        cells = cells.withColumn("cum", F.sum("c").over(Window.partitionBy("i").orderBy("v")))
        ranks = []
        for i, (_, p, n, _, _) in enumerate(brackets):
            r = p * (n - 1)
            k = int(r // 1) - int(below[f"b{i}"])  # rank inside the bracket
            ranks.append((i, k, min(k + 1, n - 1 - int(below[f"b{i}"])), r - r // 1))
        small = spark.createDataFrame(ranks, "i INT, k_lo LONG, k_hi LONG, frac DOUBLE")
        # order statistic k (0-based) is the first value whose cumulative count exceeds k
        picked = cells.join(F.broadcast(small), "i").groupBy("i").agg(
            F.min(F.when(F.col("cum") > F.col("k_lo"), F.col("v"))).alias("x_lo"),
            F.min(F.when(F.col("cum") > F.col("k_hi"), F.col("v"))).alias("x_hi"))
        got = {r["i"]: r for r in picked.collect()}
        missed = []
        for i, (c, p, n, _, _) in enumerate(brackets):
            g, (_, k_lo, _, frac) = got.get(i), ranks[i]
            if g is None or g["x_lo"] is None or g["x_hi"] is None or k_lo < 0:
                missed.append((c, p))
                continue
            x_lo, x_hi = float(g["x_lo"]), float(g["x_hi"])
            results[(c, p)] = (n, x_lo if frac == 0.0 else x_lo + (x_hi - x_lo) * frac)
        pending, delta = missed, delta * _GROWTH
    rows = [(c, p, *results[(c, p)]) for c, p in dict.fromkeys(pairs)]
    return spark.createDataFrame(rows, "column_name STRING, p DOUBLE, n LONG, value DOUBLE")


def quantile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float | None]]:
    """Same as ``exact_quantiles`` as a small driver dict {column: {p: value}} (bounded constants)."""
    out: dict[str, dict[float, float | None]] = {c: {} for c in cols}
    for r in exact_quantiles(df, cols, probs).collect():
        out[r["column_name"]][float(r["p"])] = r["value"]
    return out


def order_statistics_without(df: DataFrame, fold_col: str, folds: int, cols: Sequence[str], places: Callable[[int, int], list[list[int]]],
                             accuracy: int = _ACCURACY) -> list[dict[str, tuple[int, int, dict[int, float]]]]:
    """For every fold and column, over the rows of the other folds: (values, nulls, {place: value}).

    ``places(values, nulls)`` lists the wanted places among the sorted values (from 0), neighbouring ones as one group, the
    same number of groups for all folds. The folds are read together, as in ``exact_quantiles``: a bracket around each
    group, what lies below it, and its distinct values; a fold's counts are those of all rows less its own.
    """
    cols = list(dict.fromkeys(cols))
    x = {c: quoted(c).cast("double") for c in cols}
    own = {r[0]: r for r in df.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n"), *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)]).collect()}
    zero = [0] * (len(cols) + 1)
    count = [list(own[f][1:]) if f in own else zero for f in range(folds)]
    every = [sum(n) for n in zip(*(r[1:] for r in own.values()))] or zero
    out = [{c: (every[i + 1] - count[f][i + 1], (every[0] - count[f][0]) - (every[i + 1] - count[f][i + 1]), {}) for i, c in enumerate(cols)} for f in range(folds)]
    wanted = {(f, c): places(*out[f][c][:2]) if out[f][c][0] else [] for f in range(folds) for c in cols}
    pending = [(c, g) for c in cols for g in range(max(len(wanted[f, c]) for f in range(folds))) if any(wanted[f, c][g] for f in range(folds) if wanted[f, c])]
    # a fold's rows are about a random share of all: its places move by a few standard errors beyond the sketch's
    delta = 3.0 / accuracy + 3.0 / (max(min(every[1:], default=1), 1) * max(folds - 1, 1)) ** 0.5
    while pending:
        grids = {}
        for c, g in pending:
            at = [p / max(1, out[f][c][0] - 1) for f in range(folds) if wanted[f, c] for p in wanted[f, c][g]]
            grids[c, g] = max(0.0, min(at) - delta), min(1.0, max(at) + delta)
        need = list(dict.fromkeys(c for c, _ in pending))
        points = {c: sorted({q for (d, _), grid in grids.items() if d == c for q in grid}) for c in need}
        row = df.agg(*[F.percentile_approx(x[c], points[c], accuracy) for c in need]).collect()[0]
        found = {c: dict(zip(points[c], row[i])) for i, c in enumerate(need)}
        ends = [(c, g, None if lo <= 0.0 else found[c][lo], None if hi >= 1.0 else found[c][hi]) for (c, g), (lo, hi) in grids.items()]
        below = {r[0]: r[1:] for r in df.groupBy(fold_col).agg(*[(F.lit(0).cast("long") if lo is None else F.count(F.when(x[c] < F.lit(lo), 1))).alias(f"b{i}")
                                                                  for i, (c, _, lo, _) in enumerate(ends)]).collect()}

        def inside(c, lo, hi):
            ok = x[c].isNotNull()
            ok = ok if lo is None else ok & (x[c] >= F.lit(lo))
            return ok if hi is None else ok & (x[c] <= F.lit(hi))

        values = F.array_compact(F.array(*[F.when(inside(c, lo, hi), F.struct(F.lit(i).alias("i"), x[c].alias("v"))) for i, (c, _, lo, hi) in enumerate(ends)]))
        cells = df.select(F.col(fold_col).alias("_fold"), F.explode(values).alias("_s")).groupBy("_fold", "_s.i", "_s.v").agg(F.count(F.lit(1)).alias("c"))
        cells = cells.groupBy("i", "v").agg(*[(F.sum("c") - F.sum(F.when(F.col("_fold") == f, F.col("c")).otherwise(0))).alias(f"c{f}") for f in range(folds)])
        w = Window.partitionBy("i").orderBy("v")
        cells = cells.select("i", "v", *[F.sum(f"c{f}").over(w).alias(f"cum{f}") for f in range(folds)])
        inner = {}  # (bracket, fold) -> its places, counted from the bracket's begin
        for i, (c, g, _, _) in enumerate(ends):
            for f in range(folds):
                start = sum(b[i] for b in below.values()) - (below[f][i] if f in below else 0)
                inner[i, f] = [p - start for p in (wanted[f, c][g] if wanted[f, c] else [])]
        most = max(map(len, inner.values()))
        small = df.sparkSession.createDataFrame([(i, *[inner[i, f][j] if j < len(inner[i, f]) else None for f in range(folds) for j in range(most)]) for i in range(len(ends))],
                                                "i INT, " + ", ".join(f"p{f}_{j} LONG" for f in range(folds) for j in range(most)))
        # place p (from 0) is the first value whose cumulative count exceeds p
        picked = cells.join(F.broadcast(small), "i").groupBy("i").agg(
            *[F.min(F.when(F.col(f"cum{f}") > F.col(f"p{f}_{j}"), F.col("v"))).alias(f"x{f}_{j}") for f in range(folds) for j in range(most)])
        got, missed = {r["i"]: r for r in picked.collect()}, []
        for i, (c, g, _, _) in enumerate(ends):
            for f in range(folds):
                for j, p in enumerate(inner[i, f]):
                    v = got[i][f"x{f}_{j}"] if i in got and p >= 0 else None
                    if v is not None:
                        out[f][c][2][wanted[f, c][g][j]] = float(v)
                    elif (c, g) not in missed:
                        missed.append((c, g))
        pending, delta = missed, delta * _GROWTH
    return out
