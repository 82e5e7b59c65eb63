import numpy as np
import pytest

from tabwise.operators import prep, profile, sketches as sk


def test_merged_parts_answer_within_the_rank_error(spark):
    r = np.random.default_rng(8)
    values = np.concatenate([r.lognormal(0, 2, 30000), np.full(15000, 3.0)])
    rows = [(i % 7, float(v), float("nan") if i % 2 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "day INT, `a.b` DOUBLE, none DOUBLE")
    parts = sk.sketch_parts(df, ["a.b", "none"], "day")
    assert parts.count() == 14
    later = sk.sketch_parts(df.where("day = 9"), ["a.b"], "day")  # a load without rows adds nothing
    merged = sk.merge_parts(parts.unionByName(later)).cache()
    ordered = np.sort(values)
    for row in sk.sketch_quantiles(merged, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        if row.column_name == "none":
            assert row.n == 0 and row.value is None
            continue
        low, high = np.searchsorted(ordered, row.value, "left") / len(ordered), np.searchsorted(ordered, row.value, "right") / len(ordered)
        assert row.n == len(ordered) and low - sk.rank_error() - 1e-4 <= row.p <= high + sk.rank_error() + 1e-4
    one_day = sk.merge_parts(parts.where("part = 3"), ["part"])
    assert sk.sketch_quantiles(one_day.where("column_name = 'a.b'"), [0.5]).first().n == sum(d == 3 for d, _, _ in rows)


def test_option_of_fences_medians_and_scaling(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(1, 102)] + [(1, 1000.0)], "part INT, x DOUBLE")
    merged = sk.merge_parts(sk.sketch_parts(df, ["x"], "part"))
    fences = profile.iqr_fences(df, ["x"], sketches=merged)
    assert profile.outlier_counts(df, ["x"], fences=fences).first().n_outliers == 1
    assert abs(prep.column_medians(df, ["x"], merged)["x"] - 51.5) <= 1
    median, iqr = prep.robust_constants(df, ["x"], merged)["x"]
    assert abs(median - 51.5) <= 1 and abs(iqr - 50.5) <= 2
    with pytest.raises(ValueError, match="no sketch"):
        profile.iqr_fences(df, ["y"], sketches=merged)
