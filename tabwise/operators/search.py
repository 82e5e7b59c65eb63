"""Cross-validation (M7) and hyperparameter search (M8).

The folds are one written table with a fold number; prep is fitted for every fold (medians and
quartiles in one reading of all folds, the rest from a small driver pool), and a fit reads the rows of the other folds
from that table: the frame is copied for a fold only if resampling makes new rows. Every
(trial, fold) fit is a job of the same pool. It holds as many fits as memory has room for: a learner
keeps its rows cached, and rows that are dropped from the cache are computed anew in every round.
Fits run in even waves (ten fits, eight at most: five and five), so that no core waits for the last few.
Boosting of two classes whose rows fit in one task is a single task each (``boost``): nothing of it is cached, and
the folds, which prep reads about ten times each, are held in columns until the last score.

The search is sequential: ``init_points`` seeded points drawn uniformly inside the bounds
(md5-derived, reproducible) are scored by the mean macro F1 over stratified folds; then
``n_iter`` points are proposed in batches of ``parallelism`` from all trials scored before,
by a density ratio: the best quarter of the trials and the rest each give a density for every
parameter (normal kernels and a uniform one), ``DRAWS`` points are drawn from the first, and
the one where the first exceeds the second most is tried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_uniform, int_param
from ..sources.readers import load_params
from ..session import cut_lineage
from ..sources.writers import save_params
from .learn import Prepared, boosts_in_a_task, by_size, check_model_type, even_waves, fit_prepared, fits_at_once, prepare, score
from .metrics import fold_f1_table, macro_f1
from .prep import PrepSpec, fold_constants
from .split import stratified_folds

# Default search bounds per learner.
DEFAULT_BOUNDS = {
    "rf": {"n_estimators": (50, 1000), "max_depth": (3, 10), "min_samples_split": (2, 20),
           "min_samples_leaf": (1, 10)},
    "xgb": {"learning_rate": (0.01, 0.3), "max_depth": (3, 10), "min_child_weight": (1, 10),
            "n_estimators": (50, 1000)},
}
#: Share of the scored trials that count as good; points drawn for a proposal.
GOOD_SHARE, DRAWS = 0.25, 24
INT_PARAMS = ("n_estimators", "max_depth", "min_samples_split", "min_child_weight", "min_samples_leaf")


def candidates(spark: SparkSession, n: int, bounds: dict, seed: int = 42) -> DataFrame:
    """Candidate table: trial, one column per parameter (integer parameters truncated)."""
    df = spark.range(n).withColumnRenamed("id", "trial")
    for name, (lo, hi) in sorted(bounds.items()):
        u = hash_uniform(F.lit(str(seed)), F.col("trial").cast("string"), F.lit(name))
        v = F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))
        df = df.withColumn(name, int_param(v) if name in INT_PARAMS else v)
    return df


def _uniform(*parts) -> float:
    """The same number in [0, 1) as ``hash_uniform`` of these strings."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def _density(x: float, points: list[float]) -> float:
    """Density on [0, 1] of a uniform kernel and a normal one, of width ``len(points) ** -0.2 / 4``, around each point."""
    if not points:
        return 1.0
    width = len(points) ** -0.2 / 4
    return (1 + sum(math.exp(-((x - p) / width) ** 2 / 2) for p in points) / (width * math.sqrt(2 * math.pi))) / (len(points) + 1)


def _draw(points: list[float], *key) -> float:
    """A number in [0, 1] drawn from the density of ``points``."""
    at = int(_uniform(*key, "kernel") * (len(points) + 1))
    if at == len(points):
        return _uniform(*key, "place")
    normal = math.sqrt(-2 * math.log(1 - _uniform(*key, "place"))) * math.cos(2 * math.pi * _uniform(*key, "turn"))
    return min(1.0, max(0.0, points[at] + normal * len(points) ** -0.2 / 4))


def propose(scored: Sequence[dict], bounds: dict, trials: Sequence[int], seed: int = 42) -> list[dict]:
    """The next trials (their numbers given) from the scored ones: rows of ``trial``, the parameters and ``mean_macro_f1``.

    Equal scores: the smaller trial is the better. Parameters of equal bounds are constant.
    """
    order = sorted(scored, key=lambda t: (-t["mean_macro_f1"], t["trial"]))
    n_good = math.ceil(GOOD_SHARE * len(order))
    place = {p: [(t[p] - lo) / (hi - lo) if hi > lo else 0.0 for t in order] for p, (lo, hi) in bounds.items()}
    out = []
    for trial in trials:
        best = None
        for d in range(DRAWS):
            x = {p: _draw(place[p][:n_good], seed, trial, d, p) for p in sorted(bounds)}
            ratio = sum(math.log(_density(x[p], place[p][:n_good])) - math.log(_density(x[p], place[p][n_good:])) for p in sorted(bounds))
            if best is None or ratio > best[0]:
                best = ratio, x
        value = {p: float(lo) + best[1][p] * (float(hi) - float(lo)) for p, (lo, hi) in bounds.items()}
        out.append({"trial": trial, **{p: math.floor(v) if p in INT_PARAMS else v for p, v in value.items()}})
    return out


@dataclass
class _Fold:
    prepared: Prepared
    test: DataFrame  # the fold's rows with their vectors


def _prepared_folds(folds: DataFrame, label_col: str, k: int, keep: Sequence[str], pool: ThreadPoolExecutor, spec: PrepSpec, **prep) -> list[_Fold]:
    """Prep fitted once per fold, its quantiles for all folds at once; only resampled rows are written."""
    constants = fold_constants(folds, "fold", k, spec) or [None] * k

    def one(f: int) -> _Fold:
        prepared = prepare(folds.where(F.col("fold") != f).drop("fold"), label_col, spec=spec, constants=constants[f], **prep)
        test = prepared.assembler.transform(prepared.stage.transform(folds.where(F.col("fold") == f))).select(*keep, "features")
        return _Fold(prepared, test)
    return list(pool.map(one, range(k)))


def _score_fold(fold: _Fold, algo: str, params: dict | None, seed: int, label_type, keep: Sequence[str]) -> DataFrame:
    built = fit_prepared(fold.prepared, algo, params, seed)
    on_vectors = replace(built, model=built.model.stages[-1])
    return score(on_vectors, fold.test, keep=keep).withColumn("prediction", F.col("prediction").cast(label_type))


@contextmanager
def _stored_folds(df: DataFrame, label_col: str, id_cols: Sequence[str], k: int, seed: int, jobs: int, parallelism: int, algo: str,
                  resampled: bool) -> Iterator[tuple[DataFrame, int, bool]]:
    """(The rows with their fold, written once, in partitions by size; how many of ``jobs`` fits to run at once; whether these are tasks)."""
    folds = stratified_folds(df, label_col, id_cols, k, seed)
    rows, most = df.count(), max(1, parallelism)
    train, features = rows - rows // k, len(df.columns) - 1 - len(id_cols)
    # at most: resampling evens two classes out, every feature gets an indicator
    tasks = boosts_in_a_task(algo, folds, label_col, train * (2 if resampled else 1), 2 * features)
    fits = even_waves(jobs, most if tasks else fits_at_once(df.sparkSession, rows, len(df.columns), most))
    stored = cut_lineage(by_size(folds, rows, len(df.columns), 1 if tasks else fits))
    if not tasks:
        yield stored, fits, tasks
        return
    held = stored.select("*").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held, fits, tasks
    finally:
        held.unpersist()


def cross_validate(df: DataFrame, label_col: str, id_cols: Sequence[str], numeric_features: Sequence[str] | None = None,
                   algo: str = "xgb", resampler_type: str | None = None, scaler_type: str | None = None,
                   imputer_strategy: str | None = None, cv_splits: int = 10, seed: int = 42,
                   best_param_path: str | None = None, class_names: list | None = None,
                   params: dict | None = None, parallelism: int = 8) -> DataFrame:
    """M7 + E8: per-fold macro F1 and per-class F1 (validation's preprocessing gate, T10)."""
    check_model_type(algo)
    params = {**load_params(best_param_path, required=best_param_path is not None), **(params or {})}
    spec = PrepSpec.for_validate(numeric_features, imputer_strategy, scaler_type)
    kept = ["fold", label_col]
    with _stored_folds(df, label_col, id_cols, cv_splits, seed, cv_splits, parallelism, algo, bool(resampler_type)) as (folds, fits, tasks), \
            ThreadPoolExecutor(max_workers=fits) as pool:
        prepared = _prepared_folds(folds, label_col, cv_splits, kept, pool, spec=spec, resample_type=resampler_type, seed=seed,
                                   id_col=id_cols[0] if resampler_type else None, exclude=list(id_cols), fits=fits, pack=tasks)
        preds = list(pool.map(lambda fold: _score_fold(fold, algo, params, seed, df.schema[label_col].dataType, kept), prepared))
        every = preds[0]
        for p in preds[1:]:
            every = every.unionByName(p)
        every = cut_lineage(every)
    table = fold_f1_table(every, label_col, "prediction", "fold", class_names)
    return table.withColumn("fold", F.col("fold") + 1)


def tune(df: DataFrame, label_col: str, id_cols: Sequence[str], numeric_features: Sequence[str] | None = None,
         algo: str = "xgb", resampler: str | None = None, scaler: str | None = None,
         imputer_strategy: str | None = None, cv_splits: int = 5, seed: int = 42, init_points: int = 10,
         n_iter: int = 20, bounds: dict | None = None, parallelism: int = 8, batch: int = 4,
         save_best_param_path: str | None = None) -> tuple[dict, DataFrame]:
    """M8: (best params, trials table with mean macro F1 per candidate). ``batch`` trials are proposed at once; at most ``parallelism`` fits run at once."""
    check_model_type(algo)
    spark = df.sparkSession
    bounds = bounds or DEFAULT_BOUNDS[algo]
    spec = PrepSpec(list(numeric_features or []), [], imputer_strategy, scaler if scaler == "robust" else None)
    batches = [n for n in (init_points, min(max(1, batch), n_iter)) if n > 0]
    label_type, trials = df.schema[label_col].dataType, []

    def run(job: tuple[dict, _Fold]) -> float:
        trial, fold = job
        p = _score_fold(fold, algo, {k: v for k, v in trial.items() if k != "trial"}, seed, label_type, [label_col])
        return float(macro_f1(p, label_col, "prediction").collect()[0]["macro_f1"] or 0.0)

    with _stored_folds(df, label_col, id_cols, cv_splits, seed, min(batches, default=1) * cv_splits, parallelism, algo, bool(resampler)) as (folds, fits, tasks), \
            ThreadPoolExecutor(max_workers=fits) as pool:
        prepared = _prepared_folds(folds, label_col, cv_splits, [label_col], pool, spec=spec, resample_type=resampler, seed=seed,
                                   id_col=id_cols[0] if resampler else None, exclude=list(id_cols), fits=fits, pack=tasks)
        new = [r.asDict() for r in candidates(spark, init_points, bounds, seed).collect()]  # bounded: the search budget
        new = new or propose([], bounds, range(n_iter), seed)
        while new:
            scores = list(pool.map(run, [(t, fold) for t in new for fold in prepared]))
            trials += [{**t, "mean_macro_f1": sum(scores[i * cv_splits:(i + 1) * cv_splits]) / cv_splits} for i, t in enumerate(new)]
            left = init_points + n_iter - len(trials)
            new = propose(trials, bounds, range(len(trials), len(trials) + min(max(1, batch), left)), seed)
    best = max(trials, key=lambda t: (t["mean_macro_f1"], -t["trial"]))
    best_params = {k: (int(v) if k in INT_PARAMS else float(v)) for k, v in best.items() if k not in ("trial", "mean_macro_f1")}
    if save_best_param_path:
        save_params(best_params, save_best_param_path)
    cols = ["trial", *sorted(bounds), "mean_macro_f1"]
    return best_params, spark.createDataFrame([tuple(t[c] for c in cols) for t in trials], cols)
