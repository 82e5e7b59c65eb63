"""Classification metrics (E1-E10) as DataFrame -> DataFrame queries.

Counting is an aggregation with map-side combine; per-class numbers come
from exploding each (actual, predicted, n) cell into its three roles
(support / predicted / true positive), so no label grid is joined. Only the
label universe (bounded: the classes) is ever brought to the driver. ROC
and AUC use range-partitioned running sums over the distinct scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import global_cumulative
from .split import MAX_CLASSES


def _labels(df: DataFrame, label_col: str, pred_col: str) -> list:
    t = df.schema[label_col].dataType
    u = df.select(F.col(label_col).alias("_l")).union(df.select(F.col(pred_col).cast(t).alias("_l"))).distinct()
    return _classes(u.where(F.col("_l").isNotNull()), "_l")


def _classes(df: DataFrame, col: str) -> list:
    """Sorted distinct labels, at most MAX_CLASSES."""
    rows = df.select(col).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} distinct labels; this is no class label")
    return sorted(r[0] for r in rows)


def accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Share of rows where prediction equals label."""
    t = df.schema[label_col].dataType
    hit = (F.col(label_col) == F.col(pred_col).cast(t)).cast("double")
    return df.agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("accuracy"))


def cell_counts(df: DataFrame, label_col: str, pred_col: str, extra: list[str] | None = None) -> DataFrame:
    t = df.schema[label_col].dataType
    keys = [*(extra or []), F.col(label_col).alias("actual"), F.col(pred_col).cast(t).alias("predicted")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """(actual, predicted, n) over the sorted label union, zero-filled."""
    labels = _labels(df, label_col, pred_col)
    t = df.schema[label_col].dataType
    grid = df.sparkSession.createDataFrame([(a, p) for a in labels for p in labels],
                                           f"actual {t.simpleString()}, predicted {t.simpleString()}")
    counts = cell_counts(df, label_col, pred_col)
    return (grid.join(F.broadcast(counts), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _roles(counts: DataFrame, extra: list[str]) -> DataFrame:
    """(extra..., label, support, predicted, tp) for every label seen as truth or prediction."""
    roles = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("_r")
    r = counts.select(*extra, roles).select(*extra, "_r.*").where(F.col("label").isNotNull())
    return r.groupBy(*extra, "label").agg(F.sum("s").alias("support"), F.sum("p").alias("n_predicted"),
                                          F.sum("tp").alias("tp"))


def _with_prf(r: DataFrame) -> DataFrame:
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("n_predicted")).cast("double")),
                    F.lit(0.0))
    return r.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)


def per_class(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) for each label in truth or prediction; 0 when undefined."""
    r = _with_prf(_roles(cell_counts(df, label_col, pred_col), []))
    return r.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg' and 'weighted avg' rows (label as text)."""
    cells = cut_lineage(cell_counts(df, label_col, pred_col))  # the only pass over the input; at most classes ** 2 rows
    pc = _with_prf(_roles(cells, [])).select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    # Everything follows from the cells; accuracy is their diagonal over all rows.
    sums = pc.agg(F.sum("support").alias("total"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
                  *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    total = F.coalesce("total", F.lit(0)).cast("long").alias("support")
    none = F.lit(None).cast("double")
    accuracy_row = cells.agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double").alias("hits"),
        F.sum("n").cast("double").alias("rows"), F.sum(F.when(F.col("actual").isNotNull(), F.col("n"))).alias("total"),
    ).select(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), F.try_divide("hits", "rows").alias("f1"), total)
    averages = [sums.select(F.lit(name).alias("label"), *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")], total)
                for name, k in (("macro avg", "m"), ("weighted avg", "w"))]
    out = pc.withColumn("label", F.col("label").cast("string"))
    for rows in (accuracy_row, *averages):
        out = out.unionByName(rows)
    return out


def macro_f1(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """E5: unweighted mean F1 over the labels in truth or prediction."""
    return per_class(df, label_col, pred_col).agg(F.avg("f1").alias("macro_f1"))


def binary_f1(df: DataFrame, label_col: str = "label", pred_col: str = "prediction", positive=1) -> DataFrame:
    """F1 of the positive class."""
    pc = per_class(df, label_col, pred_col)
    return pc.where(F.col("label") == F.lit(positive)).select(F.col("f1").alias("binary_f1")).unionByName(
        df.sparkSession.createDataFrame([(0.0,)], "binary_f1 DOUBLE")).agg(F.max("binary_f1").alias("binary_f1"))


def _score_table(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    pos = (F.col(label_col) == 1).cast("long")
    return (df.where(F.col(score_col).isNotNull())
            .groupBy(F.col(score_col).cast("double").alias("score"))
            .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))


def _bends(curve: DataFrame) -> DataFrame:
    """Points (_i, score, tps, fps) of a curve, sorted by ``_i`` in their partitions, at which its slope changes, and its ends."""
    where = F.spark_partition_id().alias("part")
    ends = curve.groupBy(where).agg(*[f(F.struct("_i", "fps", "tps")).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    edges = [(tuple(r["first"]), tuple(r["last"])) for r in ends.orderBy("first").collect()]  # two rows a partition
    before = {later[0][0]: earlier[1][1:] for earlier, later in zip(edges, edges[1:])}  # by the place of a partition's first row
    after = {earlier[1][0]: later[0][1:] for earlier, later in zip(edges, edges[1:])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, and its earlier neighbour, wait for their later one

        def keep(batch: pa.RecordBatch, earlier, later) -> pa.RecordBatch:
            """The rows of ``batch`` that stay; ``earlier`` and ``later`` are (fps, tps) beside it or None at the curve's ends."""
            bend = np.zeros(batch.num_rows, bool)
            for column, name in enumerate(("fps", "tps")):
                x = batch.column(name).to_numpy()
                x = np.concatenate([[x[0] if earlier is None else earlier[column]], x, [x[-1] if later is None else later[column]]])
                bend |= np.diff(x, 2) != 0
            bend[0] |= earlier is None
            bend[-1] |= later is None
            return batch.filter(pa.array(bend))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                rows, earlier = held
                yield keep(rows, earlier, (batch.column("fps")[0].as_py(), batch.column("tps")[0].as_py()))
                earlier = (rows.column("fps")[-1].as_py(), rows.column("tps")[-1].as_py())
            else:
                earlier = before.get(batch.column("_i")[0].as_py())
            held = batch, earlier
        if held is not None:
            yield keep(*held, after.get(held[0].column("_i")[-1].as_py()))

    return curve.mapInArrow(run, curve.schema)


def roc_points(df: DataFrame, label_col: str = "label", score_col: str = "score",
               drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, descending, plus the (0, 0) start (threshold NULL).

    ``drop_intermediate`` keeps only the first and last point and the points
    where the curve changes slope (non-zero second difference of the
    false / true positive counts). The ranked points lie sorted in their partitions:
    one pass compares each with its neighbours there, and the neighbours of a partition's
    ends come from a table of two rows a partition.
    """
    st = _score_table(df, label_col, score_col)
    cum = global_cumulative(st, [F.col("score").desc()], {"tps": "pos", "fps": "neg"}, rank_col="_i")
    tot = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("D")).collect()[0]
    n_pos, n_neg, n_pts = float(tot["P"] or 0), float(tot["N"] or 0), int(tot["D"] or 0)
    if drop_intermediate and n_pts > 2:
        cum = _bends(cut_lineage(cum.select("_i", "score", "tps", "fps")))
    pts = cum.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fps").cast("double"), F.lit(n_neg)).alias("fpr"),
        F.try_divide(F.col("tps").cast("double"), F.lit(n_pos)).alias("tpr"))
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold DOUBLE, fpr DOUBLE, tpr DOUBLE")
    return start.unionByName(pts)


def auc(df: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """ROC AUC = P(score_pos > score_neg) + P(tie) / 2 (the trapezoid area of E6)."""
    st = _score_table(df, label_col, score_col)
    cum = global_cumulative(st, ["score"], {"neg_upto": "neg"}, rank_col=None)
    contrib = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0)
    return cum.agg(F.try_divide(F.sum(contrib), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def fold_f1_table(df: DataFrame, label_col: str = "label", pred_col: str = "prediction", fold_col: str = "fold",
                  class_names: list | None = None) -> DataFrame:
    """One row per fold: fold, macro_f1, F1_<class> (0.0 when the class is absent from the fold)."""
    if class_names is None:
        class_names = _classes(df.where(F.col(label_col).isNotNull()), label_col)
    r = _with_prf(_roles(cell_counts(df, label_col, pred_col, [fold_col]), [fold_col]))
    macro = r.groupBy(fold_col).agg(F.avg("f1").alias("macro_f1"))
    wide = (r.withColumn("_c", F.col("label").cast("string")).groupBy(fold_col)
            .pivot("_c", [str(c) for c in class_names]).agg(F.first("f1")))
    for c in class_names:
        wide = wide.withColumnRenamed(str(c), f"F1_{c}")
    wide = wide.fillna(0.0, subset=[f"F1_{c}" for c in class_names])
    return macro.join(wide, fold_col).select(fold_col, "macro_f1", *[f"F1_{c}" for c in class_names])


def fold_accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                  fold_col: str = "fold") -> DataFrame:
    """Accuracy per fold."""
    t = df.schema[label_col].dataType
    hit = F.coalesce((F.col(label_col) == F.col(pred_col).cast(t)).cast("double"), F.lit(0.0))
    return df.groupBy(fold_col).agg(F.avg(hit).alias("accuracy"))


def fold_accuracy_summary(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                          fold_col: str = "fold") -> DataFrame:
    """Mean and population standard deviation of the per-fold accuracy."""
    return fold_accuracy(df, label_col, pred_col, fold_col).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


class MacroF1Evaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """E5 as a pyspark.ml Evaluator (Spark's built-in 'f1' is support-weighted)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        v = macro_f1(dataset, self.getLabelCol(), self.getPredictionCol()).collect()[0]["macro_f1"]
        return float(v or 0.0)

    def isLargerBetter(self) -> bool:
        return True
