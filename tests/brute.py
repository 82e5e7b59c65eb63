"""Reference answers for tests."""

import numpy as np

from tabwise.operators.knn import sq_dist


def brute_force_knn(rows: list[tuple], k: int) -> dict[int, list[int]]:
    """Reference answer for tests: rows = (group, id, features); {id: [neighbour ids]}."""
    out = {}
    by_g: dict = {}
    for g, i, f in rows:
        by_g.setdefault(g, []).append((i, np.asarray(f, dtype=np.float64)))
    for g, items in by_g.items():
        ids = np.array([i for i, _ in items])
        fs = np.stack([f for _, f in items])
        for i, f in items:
            d2 = sq_dist(f[None, :], fs)[0]
            d2[ids == i] = np.inf
            order = np.lexsort((ids, d2))
            out[i] = [int(ids[j]) for j in order[:k] if np.isfinite(d2[j])]
    return out
