"""Approximate nearest neighbours by largest cosine, by counting collisions of single projections.

A vector of length 1 is projected on ``projections`` random normal directions. The index of a
block of vectors is one sorted array for each direction. A row collides with a query in a
direction if its projection lies in a window centred on the query's. Virtual
rehashing widens all windows step by step; a step visits only the new ends of the
windows in the sorted arrays. Rows with at least ``threshold`` collisions are verified: their
exact cosine is computed. A query ends once its windows reach ``WIDTH`` times the distance
of its k-th nearest row so far. A nearer row then collides in each direction with
probability 0.866 (a normal variable within 1.5 deviations), independently, so it has
fewer collisions than the threshold, and is missed, with probability ``MISS`` at most. No
number of candidates is capped, and windows that hold a whole block verify all of it.

Blocks are cells of a tree of cuts along the directions of largest spread, fitted on a sample
of 16 rows a cell (at most 2^18 rows and 2^14 cells; it only places the cuts, every row is
indexed); cells that come out larger than ``block_rows`` are split by a hash. Beyond 2^14 cells
blocks grow instead. A query is first searched in its own block, which
bounds the distance of its k-th nearest row, and so its windows. It then visits the
blocks whose range of projections meets its windows in enough directions: no
other block can hold a row with that many collisions. Both passes end in the exact order of what was verified.

Equal vectors are indexed once, with the k + 1 smallest of their ids: a hot vector costs no
more than any other.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do null ids. Vectors are searched among those of their own
length. A query's own rows (equal id) are no candidates; of rows that share a query's id
the smallest vector is the query. Rows equal in id and vector are one row. Equal cosines
go to the smaller id. Components are scaled by a power of two first, so very large and very small
ones do not overflow. Fewer candidates than k: all. Empty table: no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, offsets, table

K, PROJECTIONS, SEED = 5, 64, 11
#: Half a window reaches this many times the distance looked for; a nearer row is missed with this probability at most.
WIDTH, MISS = 1.5, 0.01
#: First half window, and the factor by which virtual rehashing widens it.
FIRST, WIDER = 0.05, 1.25
#: Rows of a block; cells at most; sampled rows a cell and at most; queries that meet a block in one task.
BLOCK_ROWS, MAX_CELLS, CELL_SAMPLE, MAX_SAMPLE, CHUNK_QUERIES = 1 << 13, 1 << 14, 16, 1 << 18, 1 << 12

_BLOCK = "block int, ids binary, counts binary, vectors binary, places binary, projected binary, low array<double>, high array<double>"
_FOUND = "query_id long, vec_id long, score double"
_VISIT = "block int, chunk int, id long, values array<double>, reach double"


# --- one block -------------------------------------------------------------------------------------------------------

def collision_threshold(projections: int, width: float = WIDTH, miss: float = MISS) -> int:
    """The most collisions that a row at the distance looked for fails to reach with probability ``miss`` at most."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for i in range(projections + 1):
        below += math.comb(projections, i) * p**i * (1 - p) ** (projections - i)
        if below > miss:
            return i
    return projections


def directions(dimension: int, projections: int, seed: int = SEED) -> np.ndarray:
    """(dimension, projections) normal numbers: the same for every block and task."""
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, projections))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two (so that squares stay in range; cosines do not change), and their lengths."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    small = np.ldexp(vectors, -exponent[:, None])
    return small, np.sqrt((small * small).sum(axis=1))


def project(vectors: np.ndarray, projections: int) -> np.ndarray:
    small, length = scaled(vectors)
    return (small / length[:, None]) @ directions(vectors.shape[1], projections)


class Block:
    """Sorted projections of distinct vectors, and the ids of each vector (ascending)."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, places: np.ndarray, projected: np.ndarray):
        self.ids, self.counts, self.places, self.projected = ids, counts, places, projected
        self.vectors, self.length = scaled(vectors)
        self.begin = offsets(counts)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(ids, kind="stable")
        self._sorted_ids, self._sorted_owner = ids[order], self.owner[order]

    @staticmethod
    def pack(ids: list[np.ndarray], vectors: np.ndarray, projections: int) -> dict:
        projected = project(vectors, projections).T
        places = np.argsort(projected, axis=1, kind="stable")
        projected = np.take_along_axis(projected, places, axis=1)
        return {"ids": np.concatenate(ids).astype("<i8").tobytes(), "counts": np.array([len(i) for i in ids], "<i4").tobytes(),
                "vectors": vectors.astype("<f8").tobytes(), "places": places.astype("<i4").tobytes(),
                "projected": projected.astype("<f8").tobytes(), "low": projected[:, 0].tolist(), "high": projected[:, -1].tolist()}

    @classmethod
    def unpack(cls, ids: bytes, counts: bytes, vectors: bytes, places: bytes, projected: bytes) -> Block:
        counts = np.frombuffer(counts, "<i4")
        n = len(counts)
        return cls(np.frombuffer(ids, "<i8"), counts, np.frombuffer(vectors, "<f8").reshape(n, -1),
                   np.frombuffer(places, "<i4").reshape(-1, n), np.frombuffer(projected, "<f8").reshape(-1, n))

    def windows(self, centres: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of every window: (directions, queries, widths)."""
        edges = centres.T[:, :, None], halves[None, None, :]
        first = np.stack([np.searchsorted(p, e, "left") for p, e in zip(self.projected, edges[0] - edges[1])])
        end = np.stack([np.searchsorted(p, e, "right") for p, e in zip(self.projected, edges[0] + edges[1])])
        return first, end

    def search(self, queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, k: int, threshold: int):
        """For each query (ids, cosines, distance of the k-th or infinity) of what was verified, up to the k best.

        ``reach`` is the half window beyond which a query need not look.
        """
        small, length = scaled(queries)
        centres = (small / length[:, None]) @ directions(queries.shape[1], len(self.places))
        halves = FIRST * WIDER ** np.arange(math.ceil(math.log(8 * math.sqrt(queries.shape[1] + len(self.places)) / FIRST, WIDER)) + 1)
        halves = halves[: int(np.searchsorted(halves, reach.max())) + 1]
        for at in range(0, len(queries), 64):  # windows of a few queries at a time: their places are directions x queries x widths
            some = slice(at, at + 64)
            first, end = self.windows(centres[some], halves)
            for j, q in enumerate(range(*some.indices(len(queries)))):
                yield self._one(small[q], length[q], int(query_ids[q]), centres[q], first[:, j], end[:, j], halves, float(reach[q]), k, threshold)

    def _one(self, query, length, own_id, centre, first, end, halves, reach, k, threshold):
        n, directions_ = len(self.counts), len(self.places)
        weight = self.counts.astype(np.int64)
        own = slice(*np.searchsorted(self._sorted_ids, [own_id, own_id + 1]))
        np.subtract.at(weight, self._sorted_owner[own], 1)
        collisions, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        # Before the windows hold threshold x k places no k rows can have enough collisions.
        step = int(np.searchsorted((end - first).sum(axis=0), min(threshold * min(k, n), directions_ * n)))
        lo = hi = None
        kth = math.inf
        while True:
            half = halves[min(step, len(halves) - 1)]
            if half >= reach or step >= len(halves):  # the last windows: as far as need be, or everything
                half = reach
                a = np.array([np.searchsorted(p, c - half, "left") for p, c in zip(self.projected, centre)])
                b = np.array([np.searchsorted(p, c + half, "right") for p, c in zip(self.projected, centre)])
            else:
                a, b = first[:, step], end[:, step]
            if lo is None:
                new = [p[x:y] for p, x, y in zip(self.places, a, b)]
            else:
                a, b = np.minimum(a, lo), np.maximum(b, hi)
                new = [p[x:y] for p, x, y in zip(self.places, a, lo)] + [p[x:y] for p, x, y in zip(self.places, hi, b)]
            lo, hi = a, b
            collisions += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((collisions >= threshold) & ~verified)
            if len(fresh):
                verified[fresh] = True
                cosine = (self.vectors[fresh] * query).sum(axis=1) / (self.length[fresh] * length)
                rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, cosine])
                best = np.argsort(-scores, kind="stable")
                enough = int(np.searchsorted(np.cumsum(weight[rows[best]]), k))
                if enough < len(best):
                    kth = math.sqrt(max(0.0, 2 - 2 * scores[best[enough]]))
                    keep = scores >= scores[best[enough]]
                    rows, scores = rows[keep], scores[keep]
            if half >= min(reach, WIDTH * kth) or half == math.inf:
                break
            step += 1
        spans = [np.arange(self.begin[r], self.begin[r + 1]) for r in rows]
        at = np.concatenate([*spans, np.zeros(0, np.int64)]).astype(np.int64)
        ids, values = self.ids[at], np.repeat(scores, self.counts[rows])
        other = ids != own_id
        ids, values = ids[other], values[other]
        best = np.lexsort((ids, -values))[:k]
        return ids[best], values[best], kth


# --- cells -----------------------------------------------------------------------------------------------------------

def fit_cells(projected: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Tree of cuts over sampled projections: (direction, cut, left, right); a direction of -1 is a cell, numbered in ``left``."""
    tree, leaves = [], 0
    waiting = [(np.arange(len(projected)), cells, -1, 0)]
    while waiting:
        rows, want, parent, side = waiting.pop()
        at = len(tree)
        if parent >= 0:
            tree[parent][2 + side] = at
        spread = projected[rows].std(axis=0) if len(rows) > 1 else np.zeros(1)
        d = int(spread.argmax())
        if want <= 1 or spread[d] == 0:
            tree.append([-1, 0.0, leaves, leaves])
            leaves += 1
            continue
        cut = float(np.quantile(projected[rows, d], (want // 2) / want))
        left = projected[rows, d] <= cut
        if left.all():  # ties at the cut: move it below them
            cut = float(projected[rows, d][projected[rows, d] < cut].max())
            left = projected[rows, d] <= cut
        tree.append([d, cut, 0, 0])
        waiting += [(rows[~left], want - want // 2, at, 1), (rows[left], want // 2, at, 0)]
    return [tuple(t) for t in tree]


def cell_of(tree: list[tuple[int, float, int, int]], projected: np.ndarray) -> np.ndarray:
    direction, cut, left, right = (np.array(x) for x in zip(*tree))
    at, rows = np.zeros(len(projected), np.int64), np.arange(len(projected))
    while (inner := direction[at] >= 0).any():
        low = projected[rows, np.maximum(direction[at], 0)] <= cut[at]
        at = np.where(inner, np.where(low, left[at], right[at]), at)
    return left[at]


# --- Spark -----------------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, values) of the vectors that take part; equal rows once."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return (rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("id", F.transform("v", lambda x: x + 0.0).alias("values")).distinct())


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _in_cells(rows: DataFrame, trees: dict[int, list], projections: int) -> DataFrame:
    """``rows`` with the cell of each vector among those of its length."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            widths = values.value_lengths().to_numpy()
            cell = np.zeros(len(widths), np.int32)
            for width in np.unique(widths):
                if int(width) in trees:
                    mine = np.flatnonzero(widths == width)
                    cell[mine] = cell_of(trees[int(width)], project(_matrix(values.take(pa.array(mine))), projections))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int")


def build_index(rows: DataFrame, k: int, projections: int, block_rows: int):
    """(index table, function that adds ``block`` to rows with ``values``, bounds of the blocks)."""
    spark = rows.sparkSession
    # Of equal vectors the k + 1 smallest ids: the limit is applied before the shuffle too, so a hot vector is no group.
    first = Window.partitionBy("values").orderBy("id")
    distinct = materialize(rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
                           .groupBy("values").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    trees = {}
    for r in distinct.groupBy(F.size("values").alias("w")).count().filter(F.col("count") > block_rows).collect():
        cells = min(MAX_CELLS, -(-r["count"] // block_rows))
        wanted = min(MAX_SAMPLE, max(4096, CELL_SAMPLE * cells))
        sample = distinct.filter(F.size("values") == r.w).select("values").orderBy(F.xxhash64("values"), "values").limit(wanted).toArrow()
        trees[r.w] = fit_cells(project(_matrix(sample.column("values")), projections), cells)
    placed = materialize(_in_cells(distinct, trees, projections), "placed")
    sizes = placed.groupBy(F.size("values").alias("width"), "cell").count().orderBy("width", "cell").collect()  # a row for each cell
    parts = [-(-r["count"] // max(block_rows, -(-r["count"] // MAX_CELLS))) for r in sizes]
    begin = offsets(parts)
    base = spark.createDataFrame([(r.width, r.cell, int(b), int(p)) for r, b, p in zip(sizes, begin, parts)], "width int, cell int, base int, parts int")

    def with_block(rows: DataFrame, in_cell: bool = False) -> DataFrame:
        celled = (rows if in_cell else _in_cells(rows, trees, projections)).withColumn("width", F.size("values"))
        block = F.col("base") + F.pmod(F.xxhash64("values"), F.col("parts")).cast("int")
        return celled.join(F.broadcast(base), ["width", "cell"]).select(*[c for c in rows.columns if c != "cell"], block.alias("block"))

    def build(group: pa.Table) -> pa.Table:
        ids = [np.array(i) for i in group.column("ids").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        packed = Block.pack([ids[i] for i in order], _matrix(group.column("values"))[order], projections)
        kinds = {"low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}
        return pa.table({"block": group.column("block")[:1], **{n: pa.array([v], kinds.get(n, pa.binary())) for n, v in packed.items()}})

    index = materialize(with_block(placed, True).groupBy("block").applyInArrow(build, _BLOCK), "projections")
    return index, with_block


def _search(index: DataFrame, visits: DataFrame, k: int, threshold: int, with_distance: bool) -> DataFrame:
    """Results of visits (block, chunk, id, values, reach); a block goes once to every chunk of its visits."""
    schema = _FOUND + (", kth double" if with_distance else "")

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        if data.num_rows and asked.num_rows:
            block = Block.unpack(*(data.column(c)[0].as_py() for c in ("ids", "counts", "vectors", "places", "projected")))
            names = asked.column("id").to_numpy()
            for name, (ids, scores, kth) in zip(names, block.search(_matrix(asked.column("values")), names, asked.column("reach").to_numpy(), k, threshold)):
                if with_distance and not len(ids):  # the row that carries the bound of a query without any neighbour here
                    ids, scores = [None], [None]
                for column, values in zip(columns, ([int(name)] * len(ids), list(ids), list(scores), [kth] * len(ids))):
                    column.extend(values)
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()} | ({"kth": pa.float64()} if with_distance else {})
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns)})

    chunks = visits.select("block", "chunk").distinct()
    data = index.select("block", "ids", "counts", "vectors", "places", "projected").join(chunks, "block").select(
        "block", F.col("chunk").alias("part"), "ids", "counts", "vectors", "places", "projected")
    return data.groupBy("block", "part").cogroup(visits.groupBy("block", "chunk")).applyInArrow(search, schema)


def _chunked(visits: DataFrame) -> DataFrame:
    """Visits with a chunk: at most about ``CHUNK_QUERIES`` visits of a block meet it in one task."""
    visits = materialize(visits, "visits")
    many = visits.groupBy("block").count().select("block", F.ceil(F.col("count") / CHUNK_QUERIES).cast("int").alias("chunks"))
    placed = visits.join(F.broadcast(many), "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    return materialize(placed.drop("chunks"), "chunked-visits")


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, projections: int = PROJECTIONS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every id that fulfils ``is_query``, a condition on the id column."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    spark, threshold = vectors.sparkSession, collision_threshold(projections)
    rows = materialize(usable(vectors, vec_id, vector), "usable")
    index, with_block = build_index(rows, k, projections, block_rows)
    asked = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("values").alias("values"))
    home = _chunked(with_block(asked).withColumn("reach", F.lit(math.inf)))
    near = materialize(_search(index, home, k, threshold, True), "near")
    bounds = index.select("block", "low", "high").collect()  # 2 x projections numbers a block, of at most twice 2^14 blocks and one a length
    widths = {r.block: r.width for r in index.select("block", (F.octet_length("vectors") / F.octet_length("counts") / 2).cast("int").alias("width")).collect()}
    number = np.array([b.block for b in bounds], np.int64)
    low, high = (np.array([b[i] for b in bounds]).reshape(len(bounds), projections) for i in (1, 2))
    width = np.array([widths[b] for b in number], np.int64)
    shared = spark.sparkContext.broadcast((number, low, high, width))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high, width = shared.value
        for batch in batches:
            blocks, origin = [], []
            for i, (values, home, reach) in enumerate(zip(batch.column("values"), batch.column("block").to_pylist(), batch.column("reach").to_pylist())):
                query = np.array(values.as_py())[None, :]
                centre = project(query, projections)[0]
                # A little wider than needed: bounds and centres are rounded.
                meets = ((low <= centre + reach + 1e-9) & (high >= centre - reach - 1e-9)).sum(axis=1) >= threshold
                found = number[meets & (width == query.shape[1]) & (number != home)]
                blocks.append(found)
                origin.append(np.full(len(found), i))
            at = pa.array(np.concatenate([*origin, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int32)),
                                              *(batch.column(c).take(at) for c in ("id", "values", "reach"))], ["block", "id", "values", "reach"])

    kth = near.groupBy(F.col("query_id").alias("id")).agg((F.min("kth") * WIDTH).alias("reach"))
    other = _chunked(home.drop("reach", "chunk").join(kth, "id").mapInArrow(visits, "block int, id long, values array<double>, reach double"))
    far = _search(index, other, k, threshold, False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = near.filter(F.col("vec_id").isNotNull()).drop("kth").unionByName(far)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)
