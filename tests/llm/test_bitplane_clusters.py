import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise.llm import bitplane_clusters as bp


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([1, 2, 500, (1 << 27) - 1]))
def test_planes_give_exact_products_and_sums(n, seed, size):
    r = np.random.default_rng(seed)
    values, centroid = r.integers(-size - 1, size + 1, (n, 64)), r.integers(-size - 1, size + 1, (1, 64))
    depth = int(max(size, 1)).bit_length() + 1
    rows, other = bp.planes(values, depth), bp.planes(centroid, depth)[0]
    exact = [sum(int(a) * int(b) for a, b in zip(v, centroid[0])) for v in values]
    assert bp.dots(rows, other).tolist() == exact
    assert bp.norms(rows).tolist() == [sum(int(a) ** 2 for a in v) for v in values]
    assert bp.component_sums(rows).tolist() == values.sum(axis=0).tolist()


def _brute(rows, k, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            if mine := [v for (_, v), a in zip(kept, at) if a == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [near(v) for _, v in kept]
    inertia = [sum(d for d, a in final if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, final)]


def _rows(n, seed=1):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(i % 5, 0.5))) for _ in range(64)]) for i in range(n)]
    rows += [(i, list(rows[i][1])) for i in range(0, n, 9)] + [(500 + i, [0.25] * 64) for i in range(n // 2)]  # repeated rows, one hot vector
    return rows + [(None, [1.0] * 64), (900, None), (901, []), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64),
                   (904, [float("-inf")] * 64), (905, [1.0] * 63)]


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("k, rounds", [(8, 10), (1, 2), (500, 1)])
def test_operator_equals_brute_force(spark, k, rounds):
    rows = _rows(120)
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, norm string").repartition(5)
    got = [tuple(r) for r in bp.cluster(df, k=k, rounds=rounds).collect()]
    assert sorted(got, key=KEY) == sorted(_brute(rows, k, rounds), key=KEY)


def test_empty_few_and_out_of_range(spark):
    schema = "`my.id` long, v array<double>"
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [-1.0] * 64)], schema)
    got = sorted(map(tuple, bp.cluster(df, "my.id", "v").collect()))
    assert got == sorted(_brute([(1, [0.0] * 64), (2, [-1.0] * 64)], 8, 10))
    assert bp.cluster(df.filter(F.lit(False)), "my.id", "v").count() == 0
    with pytest.raises(Exception, match="vector 3 has a component"):
        bp.cluster(spark.createDataFrame([(3, [2.0**20] * 64)], schema), "my.id", "v").collect()
