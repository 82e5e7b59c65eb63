"""Exact k-nearest neighbours (Euclidean) without an all-pairs join.

Used by SMOTE (neighbours inside a class) and ENN (neighbours over all rows).

1. Tree: a group's rows are one node. Every node of more than ``block_rows`` rows is
   split by pivots of its own (2 to ``BRANCHES`` rows with the smallest md5, about two for each
   ``block_rows`` rows): each row goes to the child of its nearest pivot. The next
   level splits the children that are still too large, so a dense cell of distinct
   points is cut as far as a sparse one. Nodes with their row counts and bounds
   (smallest and largest value of each feature) are a table, as are the pivots; nothing of them
   reaches the driver but the number of nodes left to split.
2. Pass A finds the k nearest rows inside the own leaf; the k-th distance bounds the
   true one. A row whose leaf has fewer than k others is bounded by the farthest
   corner of its parent, which has more rows than that.
3. Pass B sends every row down the tree, level by level, into the nodes whose
   bounds come within that distance, and so to the leaves that can hold a
   nearer row.
4. A leaf's data rows and query rows are cut into chunks of at most ``block_rows``
   rows; each (leaf, query chunk, data chunk) is one bounded task that computes
   distances with numpy and emits only its top k per query. The candidates of all
   tasks are merged: top k by (distance, id).

Ties are exact: a node at the very distance of the k-th row is visited (its bounds'
distance is summed in the same order as that of its rows, so rounding cannot
make it larger), and the order is (squared distance, neighbour id) everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import hash_uniform
from ..session import cut_lineage
from .ranking import BROADCAST_GROUPS, global_cumulative
from .skew import join_on_key

DEFAULT_BLOCK_ROWS = 2048
#: Children of a node at most, and levels at most (a node still too large then is cut into chunks only).
BRANCHES, MAX_LEVELS = 16, 32
# Shares that the rows of one hot point are joined in.
SALTS = 32
#: Queries whose distances are held at once (they stay in a core's cache), and rows that a task of blocks gets:
#: blocks are few bytes and much work, so their tasks are numbered by rows.
STRIP, TASK_ROWS = 64, 32_768
_SEED = 42


def sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (len(a) x len(b)), summed dimension by dimension (same order everywhere)."""
    out = np.zeros((a.shape[0], b.shape[0]), dtype=np.float64)
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        out += diff * diff
    return out


def _bounded_k_smallest(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``d2`` the k smallest finite entries by (distance, id): (row index, column index) pairs."""
    n_rows, n_cols = d2.shape
    kk = min(k, n_cols)
    if kk == 0 or n_rows == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
    r, c = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))  # ties at the k-th distance included
    order = np.lexsort((ids[c], d2[r, c], r))
    r, c = r[order], c[order]
    pos = np.arange(len(r)) - np.searchsorted(r, np.arange(n_rows))[r]
    keep = pos < kk
    return r[keep], c[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _block_topk(k: int, kind: pa.DataType):
    schema = pa.schema([("group", kind), ("qid", pa.int64()), ("nid", pa.int64()), ("d2", pa.float64())])

    def fn(block: pa.Table) -> pa.Table:
        asks, holds = block.column("_is_q").to_numpy(), block.column("_is_d").to_numpy()
        ids, f = block.column("_id").to_numpy(), _matrix(block.column("_f"))
        qid, qf, xid, xf = ids[asks], f[asks], ids[holds], f[holds]
        found = []
        for at in range(0, len(qid), STRIP):
            d2 = sq_dist(qf[at:at + STRIP], xf)
            d2[qid[at:at + STRIP, None] == xid[None, :]] = np.inf  # a point is not its own neighbour
            rows, cols = _bounded_k_smallest(d2, xid, k)
            found.append((qid[at + rows], xid[cols], d2[rows, cols]))
        if not found:
            return schema.empty_table()
        q, n, d = (np.concatenate(parts) for parts in zip(*found))
        group = pa.repeat(block.column("_g")[0], len(q))
        return pa.Table.from_arrays([group, pa.array(q), pa.array(n), pa.array(d)], schema=schema)
    return fn


def _join_small(rows: DataFrame, table: DataFrame, key: str, n_table: int) -> DataFrame:
    """Inner join with a table of ``n_table`` rows, a few for each key: broadcast up to ``BROADCAST_GROUPS`` rows, else by key with its hot keys."""
    return rows.join(F.broadcast(table), key) if n_table <= BROADCAST_GROUPS else join_on_key(rows, table, key)


def _blocks(data: DataFrame, query: DataFrame, block_rows: int, seed: int) -> DataFrame:
    """Cut every leaf into (query chunk, data chunk) blocks of at most ~block_rows rows per role."""
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block_rows)).cast("int")
    sizes = (data.groupBy("_c").agg(F.count(F.lit(1)).alias("_nd")).join(query.groupBy("_c").agg(F.count(F.lit(1)).alias("_nq")), "_c")
             .select("_c", chunks("_nd").alias("_kd"), chunks("_nq").alias("_kq")))
    sizes = cut_lineage(sizes)
    n_sizes = sizes.count()
    u = hash_uniform(F.lit(str(seed)), F.col("_id").cast("string"), F.lit("chunk"))
    d_rows = (_join_small(data, sizes, "_c", n_sizes)
              .withColumn("_dc", F.floor(u * F.col("_kd")).cast("int"))
              .withColumn("_qc", F.explode(F.sequence(F.lit(0), F.col("_kq") - 1)))
              .select("_g", "_c", "_qc", "_dc", "_id", "_f", F.lit(False).alias("_is_q"), F.lit(True).alias("_is_d")))
    q_rows = (_join_small(query, sizes, "_c", n_sizes)
              .withColumn("_qc", F.floor(u * F.col("_kq")).cast("int"))
              .withColumn("_dc", F.explode(F.sequence(F.lit(0), F.col("_kd") - 1)))
              .select("_g", "_c", "_qc", "_dc", "_id", "_f", F.lit(True).alias("_is_q"), F.lit(False).alias("_is_d")))
    return d_rows.unionByName(q_rows)


def _top_k(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("d2", "nid")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(df: DataFrame, id_col: str, feature_cols: Sequence[str], k: int, group_col: str | None = None,
        block_rows: int = DEFAULT_BLOCK_ROWS, seed: int = _SEED) -> DataFrame:
    """(group, qid, nid, d2, rank) -- the k nearest other rows of every row, rank 1..k.

    ``group_col`` restricts neighbours to the same group (class). Feature
    values must be non-null. ``id_col`` must be a unique integer id.

    Exact duplicates are handled first: among identical points only the k+1
    smallest ids can ever be anybody's neighbour (ties go to the smaller id),
    so only those enter the cell computation; every further copy gets the
    first k copies at distance 0. A hot duplicate (a third of all rows) thus
    costs a ranking and a join, not quadratic work.
    """
    g = F.col(group_col) if group_col else F.lit(0)
    # the points are read by every pass below: write them once instead of recomputing the input lineage
    pts = cut_lineage(df.select(g.alias("_g"), F.col(id_col).cast("long").alias("_id"),
                                F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in feature_cols]).alias("_f")))
    key = F.concat_ws("|", F.coalesce(F.col("_g").cast("string"), F.lit("\u0000")),
                      F.array_join(F.transform("_f", lambda x: x.cast("string")), ","))
    keyed = pts.withColumn("_key", key)
    # points repeated more than k+1 times (partial aggregation: a hot point is one row per task)
    hot = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > k + 1).select("_key")
    if hot.isEmpty():
        return _knn_cells(pts, k, block_rows, seed, len(feature_cols))
    rest = keyed.join(hot, "_key", "left_anti").select("_g", "_id", "_f")
    ranked = global_cumulative(keyed.join(hot, "_key", "left_semi"), ["_key", "_id"], rank_col="_gr")
    # ``first`` and ``copies`` hold at most k rows of a point; they are repeated for every salt, so that
    # the rows of one hot point are joined in SALTS tasks.
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    ranked = ranked.withColumn("_salt", salt)
    first = ranked.groupBy("_key").agg(F.min("_gr").alias("_g0")).select("_key", "_g0", salts)
    dup = ranked.join(first, ["_key", "_salt"]).withColumn("_dup", F.col("_gr") - F.col("_g0") + 1)
    core = rest.unionByName(dup.where(F.col("_dup") <= k + 1).select("_g", "_id", "_f"))
    copies = dup.where(F.col("_dup") <= k).select("_key", F.col("_id").alias("nid"), F.col("_dup").alias("rank"), salts)
    extra = (dup.where(F.col("_dup") > k + 1).select("_key", "_salt", "_g", F.col("_id").alias("qid"))
             .join(copies, ["_key", "_salt"])
             .select(F.col("_g").alias("group"), "qid", "nid", F.lit(0.0).alias("d2"), F.col("rank").cast("int")))
    near = _knn_cells(cut_lineage(core), k, block_rows, seed, len(feature_cols))
    return near.unionByName(extra)


def _sum_squares(terms: Sequence[Column]) -> Column:
    """Sum of the squares of one term for each feature, from the first on as in ``sq_dist``."""
    total = F.lit(0.0)
    for t in terms:
        total = total + t * t
    return total


def _to_bounds(f: Column, low: Column, high: Column, n_features: int, farthest: bool) -> Column:
    """Squared distance of a point to the nearest (or farthest) place within bounds."""
    below, above = [low[i] - f[i] for i in range(n_features)], [f[i] - high[i] for i in range(n_features)]
    if farthest:
        return _sum_squares([F.greatest(-b, -a) for b, a in zip(below, above)])
    return _sum_squares([F.greatest(b, a, F.lit(0.0)) for b, a in zip(below, above)])


def _root() -> Column:
    """Key of a group's root; children put their numbers before it, so no group's name can look like a path."""
    return F.coalesce(F.concat(F.lit("|="), F.col("_g").cast("string")), F.lit("|"))


def build_tree(pts: DataFrame, n_features: int, block_rows: int = DEFAULT_BLOCK_ROWS, seed: int = _SEED) -> tuple[DataFrame, DataFrame, int]:
    """((_g, _id, _f, _c, _parent) rows with their leaf, (_c, _parent, _n, _low, _high, _leaf) nodes, number of levels).

    A node's key ``_c`` is the numbers of the children on the way up from it, then its group.
    """
    rows = pts.withColumn("_c", _root()).withColumn("_parent", F.lit(None).cast("string"))
    leaves, nodes = None, None
    for level in range(MAX_LEVELS):
        bounds = [f(F.col("_f")[i]) for f in (F.min, F.max) for i in range(n_features)]
        found = rows.groupBy("_c", "_parent").agg(F.count(F.lit(1)).alias("_n"), F.array(*bounds[:n_features]).alias("_low"),
                                                  F.array(*bounds[n_features:]).alias("_high"))
        last = level == MAX_LEVELS - 1
        found = cut_lineage(found.withColumn("_leaf", F.lit(last) | (F.col("_n") <= block_rows)))
        n_nodes = found.count()
        nodes = found if nodes is None else nodes.unionByName(found)
        large = found.where(~F.col("_leaf")).select("_c", F.least(F.lit(BRANCHES), F.ceil(2 * F.col("_n") / block_rows)).alias("_want"))
        small = found.where("_leaf").select("_c")
        own = _join_small(rows, small, "_c", n_nodes)
        leaves = own if leaves is None else leaves.unionByName(own)
        if large.isEmpty():
            break
        inner = _join_small(rows, large, "_c", n_nodes)
        turn = F.md5(F.concat_ws("|", F.lit(f"{seed}.{level}"), F.col("_id").cast("string")))
        chosen = (inner.withColumn("_rn", F.row_number().over(Window.partitionBy("_c").orderBy(turn, "_id")))
                  .where(F.col("_rn") <= BRANCHES).where(F.col("_rn") <= F.col("_want")))
        pivots = cut_lineage(chosen.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_rn", "_f"))).alias("_pivots"))
                             .select("_c", F.transform("_pivots", lambda p: p["_f"]).alias("_pivots")))
        to_pivot = [_sum_squares([F.get(F.get("_pivots", F.lit(j)), F.lit(i)) - F.col("_f")[i] for i in range(n_features)]) for j in range(BRANCHES)]
        placed = _join_small(rows, pivots, "_c", n_nodes).withColumn("_far", F.array(*to_pivot))  # null beyond the node's last pivot
        child = F.concat_ws(".", F.array_position("_far", F.array_min("_far")).cast("string"), "_c")
        rows = cut_lineage(placed.select("_g", "_id", "_f", child.alias("_child"), F.col("_c").alias("_parent"))
                           .withColumnRenamed("_child", "_c").select("_g", "_id", "_f", "_c", "_parent"))
    return leaves, nodes, level


def visits(queries: DataFrame, nodes: DataFrame, levels: int, n_features: int) -> DataFrame | None:
    """(_g, _id, _f, _c): the leaves, other than its own, that can hold a row within ``_r2`` of a query (_g, _id, _f, _c, _r2)."""
    children = nodes.where(F.col("_parent").isNotNull()).select(F.col("_parent").alias("_node"), F.col("_c").alias("_child"), "_low", "_high", "_leaf")
    front, out, n_nodes = queries.withColumn("_node", _root()), None, nodes.count()
    for _ in range(levels):
        met = _join_small(front, children, "_node", n_nodes)
        met = met.where((F.col("_child") != F.col("_c")) & (_to_bounds(F.col("_f"), F.col("_low"), F.col("_high"), n_features, False) <= F.col("_r2")))
        met = cut_lineage(met.select("_g", "_id", "_f", "_c", "_r2", F.col("_child").alias("_node"), "_leaf"))
        at = met.where("_leaf").select("_g", "_id", "_f", F.col("_node").alias("_c"))
        out = at if out is None else out.unionByName(at)
        front = met.where(~F.col("_leaf")).drop("_leaf")
    return out


def _knn_cells(pts: DataFrame, k: int, block_rows: int, seed: int, n_features: int) -> DataFrame:
    """Exact kNN of (_g, _id, _f) points through the leaves of a pivot tree and bounded blocks."""
    gs = pts.schema["_g"].dataType.simpleString()
    out_schema = f"group {gs}, qid LONG, nid LONG, d2 DOUBLE"
    data, nodes, levels = build_tree(pts, n_features, max(block_rows, k + 1), seed)
    data = cut_lineage(data)
    cores, n_rows = pts.sparkSession.sparkContext.defaultParallelism, data.count()
    topk = _block_topk(k, to_arrow_type(pts.schema["_g"].dataType))

    def found(query: DataFrame) -> DataFrame:
        n_tasks = max(cores, -(-(n_rows + query.count()) // TASK_ROWS))
        blocks = _blocks(data.select("_g", "_id", "_f", "_c"), query, block_rows, seed).repartition(n_tasks, "_c", "_qc", "_dc")
        return blocks.groupBy("_c", "_qc", "_dc").applyInArrow(topk, out_schema)

    # pass A: neighbours inside the own leaf
    near = cut_lineage(_top_k(found(data.select("_g", "_id", "_f", "_c")), k))
    if not levels:
        return near.select("group", "qid", "nid", "d2", "rank")
    bound = near.groupBy(F.col("qid").alias("_id")).agg(F.count(F.lit(1)).alias("_k"), F.max("d2").alias("_r2")).where(F.col("_k") >= k).select("_id", "_r2")
    queries = cut_lineage(data.join(bound, "_id", "left"))
    parents = nodes.select(F.col("_c").alias("_parent"), "_low", "_high")
    loose = _join_small(queries.where(F.col("_r2").isNull() & F.col("_parent").isNotNull()), parents, "_parent", nodes.count())
    loose = loose.withColumn("_r2", _to_bounds(F.col("_f"), F.col("_low"), F.col("_high"), n_features, True))
    columns = ["_g", "_id", "_f", "_c", "_r2"]
    # pass B: only the other leaves that can hold a row within that distance
    others = visits(queries.where(F.col("_r2").isNotNull()).select(*columns).unionByName(loose.select(*columns)), nodes, levels, n_features)
    top = _top_k(near.select("group", "qid", "nid", "d2").unionByName(found(cut_lineage(others))), k)
    return top.select("group", "qid", "nid", "d2", "rank")
