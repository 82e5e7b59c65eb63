import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise.llm import topk_search as tk


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([1, 3, 200, 5000]))
def test_block_scores_equal_products(n, width, seed, size):
    r = np.random.default_rng(seed)
    values, query = r.integers(-size, size + 1, (n, width)), r.integers(-size, size + 1, width)
    block = tk.Block.unpack(**tk.Block.build(np.arange(n), values).pack())
    score = block.scores(query)
    want = values @ query
    assert [v + int(query @ block.low) for v in tk.value_of(score, np.arange(n))] == want.tolist()
    for k in (1, 5, n, n + 3):
        ids, scores = block.search(query, n // 2, k)
        best = [i for i in np.lexsort((np.arange(n), -want)) if i != n // 2][:k]
        assert ids.tolist() == best and scores.tolist() == want[best].tolist()


def test_slices_hold_values():
    values = np.array([0, 1, 5, 1023, 64])
    assert (sum(np.where(np.isin(np.arange(5), tk.rows_of(s)), 1 << j, 0) for j, s in enumerate(tk.bit_slices(values))) == values).all()


def _brute(rows, k, is_query):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        query = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in good if i != q and len(v) == len(query))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("block_rows, chunk", [(1000, 1000), (30, 2)])
def test_operator_equals_brute_force(spark, block_rows, chunk):
    r = random.Random(block_rows)
    rows = [(i, [float(np.float32(r.choice([r.gauss(0, 1), 0.5, -0.25]))) for _ in range(4)]) for i in range(200)]
    rows += [(i, list(rows[i][1])) for i in range(0, 200, 7)] + [(300 + i, [0.5] * 4) for i in range(60)]
    rows += [(None, [1.0] * 4), (400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (410, [1.0, float("nan"), 0.0, 0.0]), (420, [float("inf")] * 4), (430, [1.0, 2.0]), (431, [3.0, -2.0]), (440, [0.5, 0.5]), (450, [1.0])]
    rows += [(i, [5e6, -5e6, float(i), 5e6]) for i in (460, 461, 470)]  # large, but scores fit in 64 bits
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, block string").repartition(4)
    got = tk.top_k(df, lambda c: c % 10 == 0, block_rows=block_rows, chunk_queries=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(_brute(rows, 5, lambda i: i % 10 == 0))
    assert tk.top_k(df.filter(F.lit(False)), lambda c: c % 10 == 0).count() == 0
    few = df.filter("vec_id in (0, 1, 2)").dropDuplicates(["vec_id"])
    assert tk.top_k(few, lambda c: c == 0).count() == 2
    with pytest.raises(ValueError):
        tk.top_k(df, lambda c: c == 0, k=0)


def test_overflow_names_the_vectors(spark):
    schema = "`v.id` long, e array<double>"
    big = spark.createDataFrame([(0, [2.0**40]), (7, [2.0**40]), (8, [1.0])], schema)
    with pytest.raises(Exception, match="score of vectors 0 and 7 passes 64 bits"):
        tk.top_k(big, lambda c: c == 0, "v.id", "e").collect()
    with pytest.raises(Exception, match="vector 9 has a component beyond"):
        tk.top_k(spark.createDataFrame([(9, [2.0**60])], schema), lambda c: c == 0, "v.id", "e").collect()
    edge = spark.createDataFrame([(0, [1 / 256]), (1, [2.0**54]), (2, [-(2.0**54)])], schema)  # two longs 2^63 apart
    assert [tuple(r) for r in tk.top_k(edge, lambda c: c == 0, "v.id", "e").orderBy("rank").collect()] == [(0, 1, 1, 2**62), (0, 2, 2, -(2**62))]
