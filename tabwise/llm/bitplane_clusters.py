"""Centroid clustering of vectors of 64 components on bit planes.

Components are quantised to integers, ``floor(scale * x)``, in two's complement. Bit
plane b of a vector holds bit b of its 64 components in one unsigned 64-bit word, so a
vector of D planes is D words. The dot product of a vector and a centroid is the sum
over pairs of planes of ``weight * popcount(vector plane AND centroid plane)`` where the
weights are powers of two, the top plane's negative. Norms are dot products of a vector
with itself, squared distances ``|x|^2 + |c|^2 - 2 x.c``: all exact integers.

A round is one scan of the packed vectors: each task assigns its vectors and adds up, plane
by plane, the set bits of each cluster's components; a row per cluster and task goes to a
partial aggregation, and the driver sees only the sums of the k centroids. A hot cluster
is therefore no group of rows anywhere.

Defined results: vectors that are null, of another length than 64, or hold null or
non-finite components take no part. Rows with a null id are kept and clustered; they are
last in the order of the start. Repeated rows count each. Of the rows that share an id
the smaller vector comes first in that order. Fewer vectors than k: as many centroids as
vectors. Empty table: no rows. A component of 2^27 or more after scaling is an error that
names the id (squared distances then might pass 64 bits); so is an inertia beyond 64 bits.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, table

COMPONENTS = 64
SCALE, CLUSTERS, ROUNDS, SEED = 1024, 8, 10, 3
#: Quantised components lie below this: differences then square and add up within 63 bits.
LIMIT = 1 << 27
#: Vectors that a task works on at once.
STEP_ROWS = 4096

_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


# --- planes ----------------------------------------------------------------------------------------------------------

def weights(depth: int) -> list[int]:
    """Weight of each plane of a two's complement number, least significant first."""
    return [1 << b for b in range(depth - 1)] + [-(1 << (depth - 1))]


def planes(values: np.ndarray, depth: int) -> np.ndarray:
    """(rows, depth) words: word b holds bit b of the row's 64 components."""
    out = np.empty((len(values), depth), np.uint64)
    for b in range(depth):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _weighted(counts: np.ndarray, left: int, right: int) -> np.ndarray:
    """Sum over plane pairs of weight times popcount, for counts of shape (rows, left, right)."""
    # Below 2^53 every partial sum is exact in double precision, where matrix products are fast.
    kind = np.float64 if left + right + 6 <= 53 else np.int64
    flat = counts.reshape(len(counts), -1).astype(kind)
    return (flat @ np.outer(weights(left), weights(right)).astype(kind).ravel()).astype(np.int64)


def dots(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact dot products of packed rows (n, D) with one packed centroid (C,)."""
    return _weighted(np.bitwise_count(rows[:, :, None] & centroid[None, None, :]), rows.shape[1], len(centroid))


def norms(rows: np.ndarray) -> np.ndarray:
    return _weighted(np.bitwise_count(rows[:, :, None] & rows[:, None, :]), rows.shape[1], rows.shape[1])


def component_sums(rows: np.ndarray) -> np.ndarray:
    """Sum of each component over packed rows: set bits of a plane, times its weight."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8), axis=2, bitorder="little")
    return np.array(weights(rows.shape[1]), np.int64) @ bits.sum(axis=0, dtype=np.int64)


def nearest(rows: np.ndarray, norm: np.ndarray, centroids: list[list[int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of packed rows; ties to the smaller number."""
    exact = np.array(centroids, np.int64)
    packed = planes(exact, depth)
    best, at = None, np.zeros(len(rows), np.int32)
    for c in range(len(centroids)):
        distance = norm + int(exact[c] @ exact[c]) - 2 * dots(rows, packed[c])
        if best is None:
            best = distance
        else:
            closer = distance < best
            best, at = np.where(closer, distance, best), np.where(closer, np.int32(c), at)
    return at, best


# --- Spark -----------------------------------------------------------------------------------------------------------

def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, values) of the vectors that take part; a component out of range fails the row with its id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    kept = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") == COMPONENTS) & F.coalesce(fine, F.lit(False)))
    inside = F.forall("v", lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    error = F.raise_error(F.concat(F.lit("vector "), F.coalesce(F.col("id").cast("string"), F.lit("without id")),
                                   F.lit(f" has a component beyond 2^27 / {scale}"))).cast("array<bigint>")
    values = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select("id", F.when(inside, values).otherwise(error).alias("values"))


def _rows(batch: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("planes").cast(pa.binary())
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, depth), batch.column("norm").to_numpy()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(i, STEP_ROWS)


def pack(rows: DataFrame, depth: int) -> DataFrame:
    """(id, planes, norm): the packed vectors, written once."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            words = planes(values, depth)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([w.astype("<u8").tobytes() for w in words], pa.binary()), pa.array(norms(words))],
                ["id", "planes", "norm"])

    return materialize(rows.mapInArrow(packed, "id long, planes binary, norm long"), "planes")


def _moved(packed: DataFrame, centroids: list[list[int]], depth: int) -> list[list[int]]:
    """The centroids after one round."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), COMPONENTS + 1), np.int64)
        for batch in _pieces(batches):
            rows, norm = _rows(batch, depth)
            at, _ = nearest(rows, norm, centroids, depth)
            for c in np.unique(at):
                mine = rows[at == c]
                total[c, :COMPONENTS] += component_sums(mine)
                total[c, COMPONENTS] += len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "sums"])

    parts = packed.select("planes", "norm").mapInArrow(sums, "cluster int, sums array<bigint>")
    summed = parts.select("cluster", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {(r.cluster, r.place): int(r.s) for r in summed.collect()}  # k x 65 numbers
    out = []
    for c, old in enumerate(centroids):
        n = found.get((c, COMPONENTS), 0)
        out.append([found[c, d] // n for d in range(COMPONENTS)] if n else old)
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector, scale)
    largest = rows.agg(F.max(F.array_max(F.transform("values", lambda v: F.when(v < 0, -v - 1).otherwise(v)))).alias("m")).first().m
    if largest is None:
        return spark.createDataFrame([], _RESULT)
    depth = int(largest).bit_length() + 1
    packed = pack(rows, depth)
    start = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "values")
    centroids = [list(r["values"]) for r in start.orderBy(F.asc_nulls_last("h"), "values").limit(k).collect()]
    for _ in range(rounds):
        centroids = _moved(packed, centroids, depth)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            at, distance = nearest(*_rows(batch, depth), centroids, depth)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if (total := sum(sums.values())) >= 1 << 63:
        raise OverflowError(f"the inertia {total} passes 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = spark.createDataFrame([(c, sums.get(c, 0), total, digests[c]) for c in range(len(centroids))],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    """The rounds are common table expressions, one for each; every row has a number of its own, as ids may repeat."""
    near = """SELECT x.r, x.vec_id, x.e, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (x.e[i] - c.c[i]) * (x.e[i] - c.c[i])))::BIGINT AS d
              FROM v x CROSS JOIN c{0} c QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY d, c.cluster) = 1"""
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, e) - 1)::INTEGER AS cluster, e AS c FROM v QUALIFY cluster < {CLUSTERS})"""]
    for i in range(ROUNDS):
        steps.append(f"""
a{i} AS MATERIALIZED ({near.format(i)}),
s{i} AS MATERIALIZED (SELECT cluster, i, sum(e[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i),
m{i} AS MATERIALIZED (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.cluster = m{i}.cluster)""")
    steps.append(f"""
a AS MATERIALIZED ({near.format(ROUNDS)})""")
    return ",".join(steps) + f"""
SELECT vec_id, a.cluster, d AS distance, sum(d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} ON a.cluster = c{ROUNDS}.cluster
"""


SQL = _sql()
