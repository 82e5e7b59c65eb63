import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import collision_search as cs
from tabwise.llm.common import table


def _brute(rows, k, is_query):
    good = {(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cosine = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))
    out = {}
    for q in {i for i, _ in good if is_query(i)}:
        query = min(v for i, v in good if i == q)
        out[q] = sorted(((-cosine(query, v), i) for i, v in good if i != q and len(v) == len(query)))[:k]
    return out


def _check(got, want, recall):
    """Ranks, order and cosines are exact; the share of the true neighbours' places that was found."""
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    hits = places = 0
    for q, best in want.items():
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert all(r.vec_id != q for r in mine) and len({r.vec_id for r in mine}) == len(mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        places += len(best)
        hits += sum(-r.score <= s + 1e-12 for r, (s, _) in zip(mine, best))
    assert set(by) <= set(want) and hits >= recall * places


def _rows(width, n=400, seed=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.6))) for c in centres[i % 6]]) for i in range(n)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(200)]  # one hot vector, a third of all rows
    rows += [(2000 + i, [2 * x for x in rows[i][1]]) for i in range(0, 60, 7)]  # equal cosines
    rows += [rows[0], (10, [9.0] * width), (10, [1.0] + [0.0] * (width - 1))]  # a repeated row; an id with three vectors
    return rows + [(None, [1.0] * width), (410, None), (420, []), (430, [1.0] * (width - 1) + [None]), (440, [0.0] * width),
                   (450, [float("nan")] * width), (460, [float("inf")] * width), (470, [1.0, 2.0]), (480, [2.0, 1.0]), (481, [-1.0, 0.5])]


@pytest.mark.parametrize("block_rows, chunk", [(10000, 4096), (60, 3)])
def test_operator_against_brute_force(spark, monkeypatch, block_rows, chunk):
    monkeypatch.setattr(cs, "CHUNK_QUERIES", chunk)
    rows = _rows(24)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, values string").repartition(4)
    got = cs.nearest(df, lambda c: c % 10 == 0, block_rows=block_rows).collect()
    want = _brute(rows, 5, lambda i: i % 10 == 0)
    _check(got, want, 0.97)
    vectors = {(i, tuple(v)) for i, v in rows if v}
    hot = tuple(rows[7][1])
    for r in got:  # every row found for a query of the hot vector is one of its copies, the smallest ids first
        if r.query_id >= 1000 and (r.query_id, hot) in vectors:
            assert abs(r.score - 1) < 1e-12 and r.vec_id in ([7, *range(1000, 1007)])


def test_large_small_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [3e-310, 1e-310]), (3, [-1.0, 0.0])], "`my.id` long, v array<double>")
    got = {(r["rank"], r.vec_id): r.score for r in cs.nearest(df, lambda c: c == 0, "my.id", "v").collect()}
    assert sorted(got) == [(1, 2), (2, 1), (3, 3)] and got[2, 1] == pytest.approx(math.sqrt(0.5), rel=1e-15) and got[3, 3] == -1
    assert cs.nearest(df.filter(F.lit(False)), lambda c: c == 0, "my.id", "v").count() == 0
    assert cs.nearest(df.filter("`my.id` = 0"), lambda c: c == 0, "my.id", "v").count() == 0
    with pytest.raises(ValueError):
        cs.nearest(df, lambda c: c == 0, "my.id", "v", k=0)


def test_whole_table_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    _check(cs.op11_collision_search(spark, sf).collect(), _brute(rows, 5, lambda i: i % 50 == 0), 0.9)


def test_cells_cover_and_split():
    r = np.random.default_rng(1)
    points = np.concatenate([r.standard_normal((500, 4)), np.zeros((300, 4))])
    tree = cs.fit_cells(points, 16)
    cells = cs.cell_of(tree, points)
    assert set(cells) == set(range(cells.max() + 1)) and len(set(cells[500:])) == 1
    assert np.bincount(cells[:500]).max() < 200
    assert (cs.cell_of(cs.fit_cells(points[:1], 4), points) == 0).all()


def test_threshold_keeps_near_rows():
    m = cs.PROJECTIONS
    l = cs.collision_threshold(m)
    hits = (np.abs(np.random.default_rng(2).standard_normal((20000, m))) <= cs.WIDTH).sum(axis=1)
    assert (hits < l).mean() <= cs.MISS * 1.2
