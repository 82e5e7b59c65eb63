import math

from tabwise.operators import search

BOUNDS = {"learning_rate": (0.0, 1.0), "max_depth": (2, 10)}


def _scored(n):
    """Trials whose score falls with the distance from learning_rate 0.8 and depth 8."""
    out = []
    for t in range(n):
        x, d = search._uniform("x", t), 2 + int(8 * search._uniform("d", t))
        out.append({"trial": t, "learning_rate": x, "max_depth": d, "mean_macro_f1": 1 - abs(x - 0.8) - abs(d - 8) / 8})
    return out


def test_proposals_follow_the_scores():
    scored = _scored(40)
    new = search.propose(scored, BOUNDS, range(40, 60))
    assert [t["trial"] for t in new] == list(range(40, 60)) and new == search.propose(scored[::-1], BOUNDS, range(40, 60))
    assert all(0 <= t["learning_rate"] <= 1 and isinstance(t["max_depth"], int) and 2 <= t["max_depth"] <= 10 for t in new)
    mean = lambda rows, p: sum(r[p] for r in rows) / len(rows)
    assert abs(mean(new, "learning_rate") - 0.8) < 0.2 < abs(mean(scored, "learning_rate") - 0.8) + 0.1
    assert mean(new, "max_depth") > mean(scored, "max_depth") + 0.5
    turned = search.propose([{**t, "mean_macro_f1": -t["mean_macro_f1"]} for t in scored], BOUNDS, range(40, 60))
    assert turned != new and mean(turned, "learning_rate") < mean(new, "learning_rate")


def test_density_is_one_in_all_and_proposals_need_no_history():
    points = [0.4, 0.5, 0.55]
    # Normal kernels reach beyond [0, 1]; the whole line has three quarters of them and the unit interval the uniform quarter.
    inside = sum(search._density(i / 1000, points) for i in range(1000)) / 1000
    assert 0.9 < inside <= 1.0 and search._density(0.5, points) > search._density(0.99, points)
    assert len(search.propose([], BOUNDS, range(3))) == 3
    assert search.propose(_scored(5), {"max_depth": (4, 4)}, [9]) == [{"trial": 9, "max_depth": 4}]
    assert math.isclose(search._uniform(42, 3, "a"), search._uniform("42", "3", "a"))


def test_candidates_and_uniform_agree(spark):
    rows = search.candidates(spark, 3, BOUNDS, 42).collect()
    assert [r.learning_rate for r in rows] == [search._uniform(42, t, "learning_rate") for t in range(3)]


def test_registered_search_and_its_sql_agree():
    import duckdb

    from tabwise.plans import catalog

    names = sorted(catalog._BOUNDS)
    first = [{"trial": t, "mean_macro_f1": 1.0} for t in range(2)]
    for t in first:
        for p, (lo, hi) in catalog._BOUNDS.items():
            v = lo + search._uniform(42, t["trial"], p) * (hi - lo)
            t[p] = int(v) if p in search.INT_PARAMS else v
    rows = [(t["trial"], *(round(t[p], 6) for p in names)) for t in first + search.propose(first, catalog._BOUNDS, range(2, 4))]
    assert sorted(rows) == sorted(r[:-1] for r in duckdb.sql(catalog.ORACLES["tune"]).fetchall())
