"""SMOTE + ENN resampling (R3-R5) over the exact kNN operator.

All random choices are md5-derived from (seed, class, i), so the result is
deterministic and reproducible in any engine:

* SMOTE: every class except the majority gets ``n_max - n_c`` synthetic
  rows; synthetic row i of class c takes base row ``h1 % n_c`` (60 bits; rows of
  the class numbered by id), neighbour ``h2 % k`` of its k nearest same-class
  rows, and ``x + u (nn - x)`` with ``u`` in [0, 1). A class that needs rows but
  has k or fewer is an error.
* ENN: a row is kept only if its 3 nearest rows (over all classes) all have
  its class.

The synthetic row indices come from ``spark.range`` over the total count
(derived from the class counts of the input), joined to their base rows and
neighbours -- nothing is generated on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_int, hash_uniform
from ..session import cut_lineage
from .knn import DEFAULT_BLOCK_ROWS, knn
from .ranking import rank_within

RESAMPLERS = ("smoteenn",)
# Fixed values of the reference resampler (library defaults).
SMOTE_NEIGHBOURS = 5
ENN_NEIGHBOURS = 3
DEFAULT_SEED = 42


def check_resampler(name: str | None) -> None:
    """Only 'smoteenn' is known."""
    if name is not None and name not in RESAMPLERS:
        raise ValueError(f"unknown resampler {name!r}; known: {RESAMPLERS}")


def check_no_nulls(df: DataFrame, cols: Sequence[str]) -> None:
    """Resampling needs complete feature rows."""
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).collect()[0]
    bad = [c for c in cols if row[c]]
    if bad:
        raise ValueError(f"missing values in {bad}: impute before resampling")


def smote(df: DataFrame, id_col: str, label_col: str, feature_cols: Sequence[str], k: int = SMOTE_NEIGHBOURS,
          seed: int = DEFAULT_SEED, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Input rows plus synthetic rows (``synthetic`` = true, id = -1 - i)."""
    feats = list(feature_cols)
    spark = df.sparkSession
    counts = sorted(((r[label_col], int(r["n"])) for r in
                     df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()),
                    key=lambda t: (t[0] is None, t[0]))
    n_max = max(n for _, n in counts)
    plan, start = [], 0
    for c, n in counts:
        need = n_max - n
        if need > 0:
            if n <= k:
                raise ValueError(f"class {c!r} has {n} rows; oversampling with {k} neighbours needs {k + 1} at least")
            plan.append((c, n, start, need, k))
            start += need
    base = cut_lineage(df.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_y"), *feats))
    out = base.select(F.col("_id").alias(id_col), F.col("_y").alias(label_col), *feats,
                      F.lit(False).alias("synthetic"))
    if not plan:
        return out
    ltype = df.schema[label_col].dataType.simpleString()
    plan_df = F.broadcast(spark.createDataFrame(plan, f"_y {ltype}, _n LONG, _start LONG, _need LONG, _k INT"))
    # i in [0, total): the class owning i is found from the (few, constant) plan entries -- no join
    idx = spark.range(start).withColumnRenamed("id", "_g")
    pick = {name: None for name in ("_y", "_n", "_start", "_k")}
    for c, n, st, need, kc in plan:
        inside = F.col("_g") < F.lit(st + need)
        for name, v in (("_y", F.lit(c).cast(ltype)), ("_n", F.lit(n)), ("_start", F.lit(st)), ("_k", F.lit(kc))):
            pick[name] = F.when(inside, v) if pick[name] is None else pick[name].when(inside, v)
    idx = idx.select("_g", *[e.alias(name) for name, e in pick.items()])
    idx = idx.withColumn("_i", F.col("_g") - F.col("_start"))
    parts = (F.lit(str(seed)), F.col("_y").cast("string"), F.col("_i").cast("string"))
    idx = idx.select(
        "_g", "_y",
        (hash_int(*parts, start=0, width=15) % F.col("_n") + 1).alias("_brn"),
        (hash_int(*parts, start=15) % F.col("_k") + 1).alias("_nrank"),
        hash_uniform(*parts, start=23).alias("_u"))
    minority = base.join(plan_df.select("_y"), "_y")
    numbered = rank_within(minority, "_y", ["_id"], rank_col="_brn").select("_y", "_brn", "_id", *feats)
    nn = knn(minority, "_id", feats, k, "_y", block_rows=block_rows, seed=seed).select(
        F.col("qid").alias("_id"), F.col("rank").alias("_nrank"), F.col("nid").alias("_nid"))
    nb = base.select(F.col("_id").alias("_nid"), *[F.col(c).alias(f"_nb_{c}") for c in feats])
    syn = (idx.join(numbered, ["_y", "_brn"]).join(nn, ["_id", "_nrank"]).join(nb, "_nid")
           .select((-1 - F.col("_g")).alias(id_col), F.col("_y").alias(label_col),
                   *[(F.col(c) + F.col("_u") * (F.col(f"_nb_{c}") - F.col(c))).alias(c) for c in feats],
                   F.lit(True).alias("synthetic")))
    return out.unionByName(syn)


def enn(df: DataFrame, id_col: str, label_col: str, feature_cols: Sequence[str], k: int = ENN_NEIGHBOURS,
        seed: int = DEFAULT_SEED, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Drop every row whose k nearest rows do not all share its class."""
    nn = knn(df, id_col, feature_cols, k, None, block_rows=block_rows, seed=seed)
    lab = df.select(F.col(id_col).cast("long").alias("_nid"), F.col(label_col).alias("_nl"))
    votes = nn.join(lab, F.col("nid") == F.col("_nid")).select(F.col("qid").alias("_qid"), "_nl")
    me = df.select(F.col(id_col).cast("long").alias("_qid"), F.col(label_col).alias("_ml"))
    keep = (votes.join(me, "_qid").groupBy("_qid")
            .agg(F.bool_and(F.col("_nl").eqNullSafe(F.col("_ml"))).alias("_keep"))
            .where("_keep").select("_qid"))
    return df.join(keep, F.col(id_col).cast("long") == F.col("_qid"), "left_semi")


def smote_enn(df: DataFrame, id_col: str, label_col: str, feature_cols: Sequence[str], seed: int = DEFAULT_SEED,
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """SMOTE then ENN (fit-time only; never applied when scoring)."""
    check_no_nulls(df, [*feature_cols, label_col])
    over = cut_lineage(smote(df, id_col, label_col, feature_cols, seed=seed, block_rows=block_rows))
    return enn(over, id_col, label_col, feature_cols, seed=seed, block_rows=block_rows)
