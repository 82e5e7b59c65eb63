import numpy as np
import pytest

from brute import brute_force_knn
from tabwise.operators import knn as K


def _rows(n=260, d=4, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, None if i % 9 == 0 else "ab"[i % 2], *(float(v) / 3 for v in rng.integers(-6, 6, d))) for i in range(n)]


def _check(spark, rows, d, k=4, block_rows=16):
    df = spark.createDataFrame(rows, "id LONG, g STRING, " + ", ".join(f"x{i} DOUBLE" for i in range(d)))
    got = {}
    for r in K.knn(df, "id", [f"x{i}" for i in range(d)], k, "g", block_rows=block_rows).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    want = brute_force_knn([(g, i, list(f)) for i, g, *f in rows], k)
    assert {q: [n for _, n in sorted(v)] for q, v in got.items()} == want


def test_rows_stay_where_they_are_in_joins_with_tree_tables(spark, monkeypatch):
    def shuffled(*_):
        raise AssertionError("the rows were joined by key")
    monkeypatch.setattr(K, "join_on_key", shuffled)
    _check(spark, _rows(), 4)


def test_large_tree_tables_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_GROUPS", 0)
    _check(spark, _rows(), 4)


@pytest.mark.parametrize("strip", [1, 7, 64])
def test_strips_give_every_neighbour(spark, monkeypatch, strip):
    monkeypatch.setattr(K, "STRIP", strip)
    _check(spark, _rows(120, 2), 2, block_rows=50)


def test_blocks_get_tasks_by_rows(spark, monkeypatch):
    """Blocks are few bytes and much work: their tasks are not merged by bytes."""
    monkeypatch.setattr(K, "TASK_ROWS", 10)
    made = []
    real = K._blocks
    monkeypatch.setattr(K, "_blocks", lambda *a: made.append(real(*a)) or made[-1])
    df = spark.createDataFrame(_rows(200, 2), "id LONG, g STRING, x0 DOUBLE, x1 DOUBLE")
    near = K.knn(df, "id", ["x0", "x1"], 3, "g", block_rows=20)
    assert len(made) == 2 and near.count() == 600
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().toString()
