"""Exact top-k inner-product search on a bit-sliced index.

Vector components are quantised to integers, ``floor(scale * x)``. The index keeps,
for a block of rows and each dimension, the bits of the shifted component
``value - low`` as bitmaps: slice j of a dimension has a bit for every row.

A query's score is the sum over dimensions of its own component times the row's.
Bits of the query's components select slices: bit i of a component moves slice j
to weight i + j. Slices of equal weight are added by carry-save adders (three
bitmaps to a sum and a carry of the next weight), so the score of all rows of a
block comes out as bitmaps, one for each bit, by bitmap arithmetic alone. Negative
components of the query make a second such number that is subtracted (its
complement is added).

Top-k goes from the most significant slice downward: rows surely in, and rows
still equal at the cut. Where more rows are equal at the end than places are left,
the boundary is resolved exactly by the smaller id. Only rows that are selected
are turned into numbers.

Rows are put into blocks of about ``BLOCK_ROWS`` and queries into chunks of about
``CHUNK_QUERIES``; each chunk meets each block once (a stated query set against all
rows, in blocks), and a block gives at most k rows of each query, which a last top-k
merges. A block's slices are copied once for each chunk, and take less room than the
chunk's queries; smaller chunks, of ``LEAST_CHUNK`` queries at least, are made only while there are fewer tasks than cores.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part. Vectors meet those of their own length. Bitmaps have no largest number, and
what leaves them is added up without rounding: a component beyond 63 bits after scaling,
or a score beyond 63 bits among the k highest, is an error that names the vector. A query's own
rows (equal id) are no candidates. Rows that share an id are candidates of their
own; of those that share a query's id the smallest vector is the query. Equal scores go to the smaller id. Null ids take no part. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, table

SCALE, K = 256, 5
#: Rows of an index block, queries of a chunk, and queries of a chunk that is made for another core.
BLOCK_ROWS, CHUNK_QUERIES, LEAST_CHUNK = 1 << 15, 1 << 14, 128


# --- bitmap arithmetic -----------------------------------------------------------------------------------------------

def bit_slices(values: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (64 rows a word) of non-negative integers, least significant first; as many as the largest value needs."""
    words = -(-len(values) // 64)
    out = []
    for j in range(int(values.max(initial=0)).bit_length()):
        bits = np.zeros(words * 64, bool)
        bits[: len(values)] = (values >> values.dtype.type(j)) & values.dtype.type(1)
        out.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return out


def add_all(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bit slices of the sum of bitmaps listed by weight (number of twos in their factor)."""
    out, weight = [], 0
    while any(w >= weight for w in columns):
        level = columns.pop(weight, [])
        carry = columns.setdefault(weight + 1, []) if len(level) > 1 else []
        while len(level) > 2:
            # Full adders over stacks: three bitmaps of one weight are one of it and one of the next.
            n = len(level) // 3
            stack = np.stack(level[: 3 * n]).reshape(3, n, words)
            a, b, c = stack
            half = a ^ b
            carry.extend((a & b) | (half & c))
            level = [*(half ^ c), *level[3 * n:]]
        if len(level) == 2:
            carry.append(level[0] & level[1])
            level = [level[0] ^ level[1]]
        out.append(level[0] if level else np.zeros(words, np.uint64))
        weight += 1
        columns = {w: x for w, x in columns.items() if x}
    return out


def subtract(a: list[np.ndarray], b: list[np.ndarray], words: int) -> list[np.ndarray]:
    """Slices of a - b in two's complement, the sign slice last."""
    zero, n = np.zeros(words, np.uint64), max(len(a), len(b)) + 1
    carry, out = ~zero, []
    for i in range(n):
        x, y = a[i] if i < len(a) else zero, ~(b[i] if i < len(b) else zero)
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    return out


def top_rows(score: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows surely in, rows equal at the cut, places left for these): the k highest of ``among``, sign slice last."""
    sure, equal = np.zeros_like(among), among.copy()
    left = min(k, int(np.bitwise_count(among).sum()))
    slices = [~score[-1], *score[-2::-1]]  # the sign's complement: non-negative scores are higher
    for bits in slices:
        if not left:
            return sure, np.zeros_like(among), 0
        high = equal & bits
        n = int(np.bitwise_count(high).sum())
        if n > left:
            equal = high
        else:
            sure |= high
            equal &= ~bits
            left -= n
    return sure, equal, left


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def value_of(score: list[np.ndarray], rows: np.ndarray) -> list[int]:
    """The numbers of selected rows from the slices, of any size."""
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    out = [0] * len(rows)
    for i, bits in enumerate(score):
        weight = -(1 << i) if i == len(score) - 1 else 1 << i
        out = [v + weight if b else v for v, b in zip(out, ((bits[word] >> bit) & np.uint64(1)).tolist())]
    return out


class Block:
    """Index of some rows: slices of every dimension. Rows are in ascending order of id."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: list[np.ndarray]):
        self.ids, self.low, self.slices = ids, low, slices
        self.words = -(-len(ids) // 64)
        bits = np.zeros(self.words * 64, bool)
        bits[: len(ids)] = True
        self.everyone = np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0)
        above = values.astype(np.uint64) - low.astype(np.uint64)  # below 2^64 and modulo 2^64: exact for any two longs
        return cls(ids, low, [np.array(bit_slices(above[:, d]), np.uint64).reshape(-1, -(-len(ids) // 64)) for d in range(values.shape[1])])

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.astype("<i8").tobytes(), "low": self.low.astype("<i8").tobytes(),
                "depth": np.array([len(x) for x in self.slices], "<i4").tobytes(), "bits": b"".join(x.tobytes() for x in self.slices)}

    @classmethod
    def unpack(cls, ids: bytes, low: bytes, depth: bytes, bits: bytes) -> Block:
        ids, depth = np.frombuffer(ids, "<i8"), np.frombuffer(depth, "<i4")
        slices = np.frombuffer(bits, "<u8").reshape(int(depth.sum()), -(-len(ids) // 64))
        return cls(ids, np.frombuffer(low, "<i8"), np.split(slices, np.cumsum(depth)[:-1]))

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of ``sum(query * (row - low))`` of every row."""
        sides = []
        for sign in (1, -1):
            columns: dict[int, list[np.ndarray]] = {}
            for d in np.flatnonzero(query > 0 if sign > 0 else query < 0):
                size = int(query[d]) * sign
                for i in range(size.bit_length()):
                    if size >> i & 1:
                        for j, bits in enumerate(self.slices[d]):
                            columns.setdefault(i + j, []).append(bits)
            sides.append(add_all(columns, self.words))
        return subtract(*sides, self.words)

    def search(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, best first, ties to the smaller id."""
        among = self.everyone.copy()
        own = np.arange(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        np.bitwise_and.at(among, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        score = self.scores(query)
        sure, equal, left = top_rows(score, among, k)
        rows = np.concatenate([rows_of(sure), rows_of(equal)[:left]])  # rows are in order of id: the first are the smaller ids
        shift = sum(int(q) * int(v) for q, v in zip(query, self.low))
        best = sorted((-value - shift, int(i)) for value, i in zip(value_of(score, rows), self.ids[rows]))
        for value, i in best:
            if not -(1 << 63) <= -value < 1 << 63:
                raise OverflowError(f"the score of vectors {query_id} and {i} passes 64 bits")
        return np.array([i for _, i in best], np.int64), np.array([-v for v, _ in best], np.int64)


# --- Spark -----------------------------------------------------------------------------------------------------------

def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, values) of the vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    inside = F.forall("v", lambda x: F.abs(x.cast("double") * scale) < float(1 << 63))
    error = F.raise_error(F.concat(F.lit("vector "), F.col("id").cast("string"), F.lit(f" has a component beyond 2^63 / {scale}"))).cast("array<bigint>")
    values = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select("id", F.when(inside, values).otherwise(error).alias("values"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks])
    return flat.astype(np.int64).reshape(len(column), -1)


def build_index(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(block, ids, low, depth, bits): the bit slices of every row of (id, values), in the blocks that ``plan`` gives each length."""
    def build(group: pa.Table) -> pa.Table:
        block = Block.build(group.column("id").to_numpy(), _matrix(group.column("values")))
        return pa.table({"block": group.column("block")[:1], **{k: pa.array([v], pa.binary()) for k, v in block.pack().items()}})

    place = F.col("base") + F.pmod(F.xxhash64("id", "values"), F.col("blocks")).cast("int")
    placed = rows.withColumn("width", F.size("values")).join(F.broadcast(plan), "width").select(place.alias("block"), "id", "values")
    return materialize(placed.groupBy("block").applyInArrow(build, "block int, ids binary, low binary, depth binary, bits binary"), "slices")


def _plan(rows: DataFrame, asked: DataFrame, block_rows: int, chunk_queries: int) -> DataFrame:
    """(width, base, blocks, chunks): a row for each length of vectors."""
    spark, base, out = rows.sparkSession, 0, []
    width = F.size("values").alias("width")
    queries = {r.width: r["count"] for r in asked.groupBy(width).count().collect()}
    cores = spark.sparkContext.defaultParallelism
    for r in rows.groupBy(width).count().orderBy("width").collect():
        blocks, n = -(-r["count"] // block_rows), queries.get(r.width, 0)
        more = min(-(-cores // blocks), -(-n // LEAST_CHUNK))
        out.append((r.width, base, blocks, max(1, -(-n // chunk_queries), more)))
        base += blocks
    return spark.createDataFrame(out, "width int, base int, blocks int, chunks int")


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every id that fulfils ``is_query``, a condition on the id column."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    rows = materialize(quantised(vectors, vec_id, vector, scale), "quantised")
    asked = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("values").alias("values"))
    plan = F.broadcast(_plan(rows, asked, block_rows, chunk_queries))
    index = build_index(rows, plan)
    # The tasks are (block, chunk).
    until = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    chunks = plan.select(F.explode(F.sequence("base", F.col("base") + F.col("blocks") - 1)).alias("block"), "chunks")
    data = index.join(F.broadcast(chunks), "block").withColumn("chunk", F.explode(until("chunks"))).drop("chunks")
    queries = (asked.withColumn("width", F.size("values")).join(plan, "width")
               .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
               .withColumn("block", F.explode(F.sequence("base", F.col("base") + F.col("blocks") - 1))).select("block", "chunk", "id", "values"))

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if data.num_rows and queries.num_rows:
            block = Block.unpack(*(data.column(c)[0].as_py() for c in ("ids", "low", "depth", "bits")))
            for query_id, query in zip(queries.column("id").to_pylist(), _matrix(queries.column("values"))):
                ids, scores = block.search(query, query_id, k)
                for column, values in zip(out, (np.full(len(ids), query_id), ids, scores)):
                    column.append(values)
        join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    found = data.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
