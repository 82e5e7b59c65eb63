import math

import numpy as np
from pyspark.sql import functions as F

from tabwise.operators import gram, profile


def _frame(spark, n=500, columns=9):
    r = np.random.default_rng(4)
    x = 1e6 + r.standard_normal((n, columns)).cumsum(axis=1)
    x[:, 3] = 7.1  # constant
    rows = [[None if r.random() < 0.2 and c > 1 else float(v) for c, v in enumerate(row)] for row in x]
    for row in rows:
        row[8] = 5.0 if row[7] is not None else float(r.random())  # constant over the rows of one pair
    return spark.createDataFrame(rows, ", ".join(f"`c.{i}` DOUBLE" if i == 0 else f"c{i} DOUBLE" for i in range(columns))), rows


def test_gram_equals_numpy(spark):
    df, rows = _frame(spark)
    x = np.array([[math.nan if v is None else v for v in row] for row in rows])
    got = {(r.col_a, r.col_b): r["corr"] for r in gram.gram_correlation(df.repartition(3), df.columns).collect()}
    assert len(got) == len(df.columns) ** 2
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            if np.ptp(u) == 0 or np.ptp(v) == 0:
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(u, v)[0, 1]) < 1e-9 and got[a, b] == got[b, a]


def test_wide_tables_take_the_gram_matrix_and_agree(spark, monkeypatch):
    df = _frame(spark)[0].withColumnRenamed("c.0", "c0")
    plain = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(df).collect()}
    monkeypatch.setattr(profile, "PAIRS_A_PASS", 3)
    wide = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(df).collect()}
    assert plain.keys() == wide.keys()
    # The Gram matrix knows a constant exactly; merged variances may leave a rounding error of it.
    assert {k for k, w in wide.items() if w is None} == {k for k in wide if "c3" in k or set(k) == {"c7", "c8"}}
    assert all(abs(plain[k] - w) < 1e-8 for k, w in wide.items() if w is not None)


def test_odd_values_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, float("nan"), 1.0), (4.0, None, 2.0), (None, float("inf"), None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = {(r.col_a, r.col_b): r["corr"] for r in gram.gram_correlation(df, ["a", "b", "c"]).collect()}
    assert math.isnan(got["a", "b"]) and math.isnan(got["b", "b"]) and abs(got["a", "c"] - np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1]) < 1e-12
    empty = gram.gram_correlation(df.where(F.lit(False)), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)
