import numpy as np
import pytest

from brute import brute_force_knn
from tabwise.operators.knn import knn
from tabwise.operators.resample import check_resampler, enn, smote, smote_enn


def _points(spark, n=300, hot=100, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = "a" if i % 3 else "b"
        if i < hot:  # a dense clump: one cell holds a third of all rows
            f = [0.5 + rng.integers(0, 4) * 1e-3, 0.5]
        else:
            f = [float(rng.integers(0, 50)) / 10, float(rng.integers(0, 50)) / 10]  # grid values -> ties
        rows.append((i, g, float(f[0]), float(f[1])))
    return spark.createDataFrame(rows, "id LONG, g STRING, x DOUBLE, z DOUBLE"), rows


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_knn_equals_brute_force(spark, block_rows):
    df, rows = _points(spark)
    got = {}
    for r in knn(df, "id", ["x", "z"], 5, "g", block_rows=block_rows).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    got = {q: [n for _, n in sorted(v)] for q, v in got.items()}
    want = brute_force_knn([(g, i, [x, z]) for i, g, x, z in rows], 5)
    assert got == want


def test_knn_without_groups(spark):
    df, rows = _points(spark, n=120, hot=30)
    got = {}
    for r in knn(df, "id", ["x", "z"], 3, None, block_rows=8).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    got = {q: [n for _, n in sorted(v)] for q, v in got.items()}
    assert got == brute_force_knn([(0, i, [x, z]) for i, _, x, z in rows], 3)


def test_smote_balances_and_interpolates(spark):
    df, rows = _points(spark, n=90, hot=0)
    out = smote(df, "id", "g", ["x", "z"], block_rows=16)
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts["a"] == counts["b"] == 60
    syn = out.where("synthetic").collect()
    assert len(syn) == 30 and all(r.id < 0 for r in syn)
    b_pts = np.array([[x, z] for _, g, x, z in rows if g == "b"])
    lo, hi = b_pts.min(axis=0), b_pts.max(axis=0)
    assert all(lo[0] <= r.x <= hi[0] and lo[1] <= r.z <= hi[1] for r in syn)
    again = smote(df, "id", "g", ["x", "z"], block_rows=16).where("synthetic").collect()
    assert sorted(map(tuple, syn)) == sorted(map(tuple, again))


def test_enn_matches_rule(spark):
    df, rows = _points(spark, n=150, hot=0)
    kept = {r.id for r in enn(df, "id", "g", ["x", "z"], block_rows=16).collect()}
    nn = brute_force_knn([(0, i, [x, z]) for i, _, x, z in rows], 3)
    label = {i: g for i, g, _, _ in rows}
    want = {i for i in label if all(label[j] == label[i] for j in nn[i])}
    assert kept == want


def test_resampler_guards(spark):
    with pytest.raises(ValueError):
        check_resampler("smote")
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "id LONG, g STRING, x DOUBLE")
    with pytest.raises(ValueError):
        smote_enn(df, "id", "g", ["x"])


def test_knn_hot_duplicate_third_of_rows(spark):
    rows = [(i, "a", 1.0, 1.0) for i in range(60)]  # one point holds a third of all rows
    rows += [(100 + i, "a" if i % 2 else "b", float(i % 13) / 3, float(i % 7) / 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id LONG, g STRING, x DOUBLE, z DOUBLE")
    got = {}
    for r in knn(df, "id", ["x", "z"], 5, "g", block_rows=8).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid, r.d2))
    want = brute_force_knn([(g, i, [x, z]) for i, g, x, z in rows], 5)
    assert {q: [n for _, n, _ in sorted(v)] for q, v in got.items()} == want
    assert sorted(got[59]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 3, 0.0), (5, 4, 0.0)]
