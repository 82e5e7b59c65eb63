import pytest

from tabwise.operators import metrics


@pytest.fixture
def scored(spark):
    # truth / prediction with a label only predicted (3) and one never predicted (2)
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1), (1, 3)]
    return spark.createDataFrame(rows, "label INT, prediction INT")


def test_accuracy_confusion(scored):
    assert metrics.accuracy(scored).collect()[0].accuracy == pytest.approx(3 / 7)
    cm = {(r.actual, r.predicted): r.n for r in metrics.confusion(scored).collect()}
    assert len(cm) == 16 and cm[(0, 0)] == 2 and cm[(1, 3)] == 1 and cm[(3, 3)] == 0


def test_per_class_zero_division(scored):
    pc = {r.label: r for r in metrics.per_class(scored).collect()}
    assert pc[2].precision == 0.0 and pc[2].recall == 0.0 and pc[2].f1 == 0.0
    assert pc[3].support == 0 and pc[3].f1 == 0.0
    assert pc[0].precision == pytest.approx(2 / 3) and pc[0].recall == pytest.approx(2 / 3)


def test_macro_is_not_weighted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label INT, prediction INT")
    assert metrics.macro_f1(df).collect()[0].macro_f1 == pytest.approx(((4 / 5) + (2 / 3)) / 2)
    rep = {r.label: r for r in metrics.report(df).collect()}
    assert rep["weighted avg"].f1 == pytest.approx((3 * 0.8 + 1 * (2 / 3)) / 4)
    assert rep["accuracy"].f1 == pytest.approx(0.75) and rep["accuracy"].support == 4


def test_auc_and_roc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(rows, "y INT, score DOUBLE")
    # pairs: positives {0.9, 0.8, 0.3} vs negatives {0.8, 0.3, 0.1}
    wins = sum((p > n) + 0.5 * (p == n) for yp, p in rows if yp == 1 for yn, n in rows if yn == 0)
    assert metrics.auc(df, "y", "score").collect()[0].auc == pytest.approx(wins / 9)
    pts = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, "y", "score").collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0) and len(pts) == 5


def test_fold_table_and_evaluator(spark):
    rows = [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0), (0, 0, 1), (1, 0, 1)]
    df = spark.createDataFrame(rows, "fold INT, label INT, prediction INT")
    t = {r.fold: r for r in metrics.fold_f1_table(df, class_names=[0, 1, 2]).collect()}
    assert set(t) == {0, 1} and t[0].F1_2 == 0.0
    ev = metrics.MacroF1Evaluator()
    assert ev.evaluate(df) == pytest.approx(metrics.macro_f1(df).collect()[0].macro_f1)
    s = metrics.fold_accuracy_summary(df).collect()[0]
    assert s.mean_accuracy == pytest.approx((2 / 3 + 1 / 3) / 2)


def test_report_text_file(spark, tmp_path):
    from tabwise.sources import write_report_text
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label INT, prediction INT")
    write_report_text(metrics.report(df), str(tmp_path / "r.txt"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r.txt").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == "Accuracy: 0.7500" and lines[1] == "" and lines[2] == "Classification Report:"
    assert "precision" in lines[3] and lines[4].split()[0] == "0" and lines[-1].split()[0] == "weighted"


def test_roc_drop_intermediate(spark):
    import numpy as np
    rows = [(1, 0.9), (1, 0.85), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4), (0, 0.3), (1, 0.2)]
    df = spark.createDataFrame(rows, "y INT, score DOUBLE")
    full = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, "y", "score").collect())
    kept = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, "y", "score", drop_intermediate=True).collect())
    # the library rule on the same counts: keep where the second difference is non-zero
    ys = [y for y, _ in sorted(rows, key=lambda t: -t[1])]
    tps, fps = np.cumsum(ys), np.cumsum([1 - y for y in ys])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = sorted([(0.0, 0.0)] + [(f / 4, t / 5) for f, t, k in zip(fps, tps, keep) if k])
    assert kept == want and len(kept) < len(full)


@pytest.mark.parametrize("parts", [1, 8])
def test_curve_without_straight_points_over_partitions(spark, parts):
    import numpy as np

    r = np.random.default_rng(parts)
    rows = [(int(r.random() < s / 40), float(s)) for s in r.integers(0, 40, 300)] + [(1, 100.0 + i) for i in range(30)] + [(0, -1.0 - i) for i in range(30)]
    df = spark.createDataFrame(rows, "label INT, score DOUBLE").repartition(parts)
    got = sorted(((r.threshold, r.fpr, r.tpr) for r in metrics.roc_points(df, drop_intermediate=True).collect() if r.threshold is not None), reverse=True)
    scores = sorted({s for _, s in rows}, reverse=True)
    tps = [sum(y for y, s in rows if s >= t) for t in scores]
    fps = [sum(1 - y for y, s in rows if s >= t) for t in scores]
    keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1) or tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]]
    assert len(keep) < len(scores) - 50
    assert got == [(scores[i], fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]
