"""SimHash near-duplicates through vantage-point trees.

Fingerprints are reduced to distinct values first, so copies, however many,
are one point. The top of a vantage-point tree, built from a bounded sample
(``SAMPLE`` fingerprints, or 16 for each shard wanted up to ``MAX_SAMPLE``, the smallest by hash), cuts the space into shards: at
each node a point goes inside if its Hamming distance to the vantage point is at
most the median distance, else outside. A point whose ball of ``max_bits``
crosses the boundary could have partners on the other side too, so it is also
sent there as a visitor (triangle bound); of two shards only the one with the
smaller number gets the visitor, which keeps each pair once. The sample only
decides where the cuts lie: every fingerprint is in a shard and every pair within
``max_bits`` is found, exactly.

Inside a shard the tree goes on: build and query run together over arrays, and
leaves are compared by popcount. A shard returns a spanning forest of the links
it found, not the pairs (a point has at most 2,080 partners at 2 bits, as points
are distinct). Star contraction joins the forests of all shards to components.

Defined results: a null or empty text has fingerprint 0, linked like any other.
component_id is the smallest non-null doc_id of the component (null if it has
none). Repeated rows get equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, set_aside, steps, table, text_bytes

SHINGLE, MAX_BITS = 3, 2
#: Fingerprints that the top of the tree is built from at least (if there are); about so many distinct fingerprints a shard; points of a leaf.
SAMPLE, SHARD_POINTS, LEAF = 20_000, 4_096, 192
#: The sample has this many fingerprints for each shard, and at most so many (8 MB on the driver; 65,536 shards).
SHARD_SAMPLE, MAX_SAMPLE = 16, 1 << 20
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (XXH64, seed 42): a bit is 1 if set in over half of the hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[:-shingle].tolist()], (ends[shingle - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` and __fp, the fingerprint as a signed long."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "__fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("__text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints)], names=[*names, "__fp"])

    source = docs.select(*names, text_bytes(F.col(text)).alias("__text"))
    return source.mapInArrow(run, docs.select(*names).schema.add("__fp", "long"))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


# --- the top of the tree: shards -------------------------------------------------------------------------------------

def shard_tree(sample: np.ndarray, depth: int) -> list | int:
    """Nested [vantage point, radius, inside, outside]; leaves are shard numbers from left to right."""
    made = 0

    def node(points: np.ndarray, depth: int):
        nonlocal made
        cut = _cut(points) if depth and len(points) > 1 else None
        if cut is None:
            made += 1
            return made - 1
        vantage, radius, inside = cut
        return [vantage, radius, node(points[inside], depth - 1), node(points[~inside], depth - 1)]

    return node(sample, depth)


def _cut(points: np.ndarray):
    """Vantage point, radius and who is inside, of a few candidates the one whose boundary has fewest points beside it; None if none divides."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        d = distance(points, vantage).astype(np.int64)
        radius = int(np.median(d))
        inside = d <= radius
        if inside.all():
            radius -= 1
            inside = d <= radius
        if inside.any() and not inside.all():
            beside = float(np.mean(np.abs(d - radius) <= 2)) + abs(float(inside.mean()) - 0.5)
            if best is None or beside < best[0]:
                best = beside, vantage, radius, inside
    return best and best[1:]


def shards_of(tree, points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every shard that a point belongs to or visits; visits only below its home's number."""
    rows, shards, homes = [], [], []

    def walk(node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            rows.append(at), shards.append(np.full(len(at), node)), homes.append(home)
            return
        vantage, radius, inner, outer = node
        d = distance(points[at], vantage).astype(np.int64)
        within = d <= radius
        go = within | (d - max_bits <= radius)
        walk(inner, at[go], home[go] & within[go])
        # To the right go those at home there; a visit from the left would be to a larger number than its home.
        go = ~within & home | ~home & (d + max_bits > radius)
        walk(outer, at[go], home[go] & ~within[go])

    everyone = np.arange(len(points))
    walk(tree, everyone, np.ones(len(points), bool))
    join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
    return join(rows, np.int64), join(shards, np.int64), join(homes, bool)


# --- inside a shard --------------------------------------------------------------------------------------------------

def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member number of each point's component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while (label[label] != label).any():
            label = label[label]


def linked(points: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels of one shard's points, by links of which one end at least is at home here."""
    edges, held = [], 0

    def merge() -> None:
        nonlocal edges, held
        if held:
            label = components(len(points), np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            rest = np.flatnonzero(label != np.arange(len(points)))
            edges, held = [(rest, label[rest])], len(rest)

    def search(tree_at: np.ndarray, asked: np.ndarray) -> None:
        nonlocal held
        if not len(tree_at) or not len(asked):
            return
        cut = _cut(points[tree_at]) if len(tree_at) > LEAF else None
        if cut is None:
            for i in range(0, len(asked), 4096):
                q = asked[i:i + 4096]
                near, mine = np.nonzero(distance(points[q][:, None], points[tree_at][None, :]) <= max_bits)
                u, v = q[near], tree_at[mine]
                keep = u != v
                edges.append((u[keep], v[keep]))
                held += int(keep.sum())
                if held > 4 * len(points) + (1 << 20):
                    merge()
            return
        vantage, radius, inside = cut
        d = distance(points[asked], vantage).astype(np.int64)
        search(tree_at[inside], asked[d - max_bits <= radius])
        search(tree_at[~inside], asked[d + max_bits > radius])

    search(np.flatnonzero(home), np.arange(len(points)))
    merge()
    label = np.arange(len(points))
    if edges:
        label[edges[0][0]] = edges[0][1]
    return label


# --- the operator ----------------------------------------------------------------------------------------------------

def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node reachable. Large-star and small-star in turn."""
    both = lambda e: e.union(e.select("b", "a"))
    edges = materialize(edges.toDF("a", "b").filter("a <> b"), "links")
    before = None
    while True:
        least = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both(edges).filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").filter("b <> m").select("b", "m").union(least)).toDF("a", "b").filter("a <> b").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 40))).first()
        if now == before:
            return edges.toDF("node", "root")
        before = now


def near_components(prints: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(fp, root) for every distinct value of ``prints.fp`` that has another within ``max_bits``."""
    spark = prints.sparkSession
    n = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard_points)))))
    sample = max(sample, min(SHARD_SAMPLE << depth, MAX_SAMPLE))
    some = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = shard_tree(some, min(depth, max(0, int(np.log2(max(1, len(some) / SHARD_SAMPLE))))))
    shared = spark.sparkContext.broadcast(tree)  # a node for every two shards, at most MAX_SAMPLE / SHARD_SAMPLE shards

    def assign(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            row, shard, home = shards_of(shared.value, points.view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(points[row]), pa.array(home)], names=["shard", "fp", "home"])

    def link(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().astype(np.int64)
        label = linked(points.view(np.uint64), group.column("home").to_numpy(), max_bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": points[moved], "b": points[label[moved]]})

    placed = prints.select("fp").mapInArrow(assign, "shard int, fp long, home boolean")
    return star_components(placed.groupBy("shard").applyInArrow(link, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", fp: str = "__fp", max_bits: int = MAX_BITS, roots: bool = False, **shards) -> DataFrame:
    """``docs`` (a table that can be read again, with fingerprints) with component_id; with ``roots``, also __root, a fingerprint for each component."""
    docs = docs.drop("component_id")
    prints = materialize(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "prints")
    links = near_components(prints, max_bits, **shards)
    of = prints.join(links, prints.fp == links.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    known = of.join(least, "root").select(F.col("fp").alias("__of"), "component_id", *([F.col("root").alias("__root")] if roots else []))
    return docs.join(known, docs[fp] == known["__of"], "left").drop("__of")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = materialize(with_fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]), "fingerprints")
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays (of repeated rows, one)."""
    docs, columns = set_aside(docs, ("doc_id", "text"))
    prints = materialize(with_fingerprints(docs), "fingerprints")
    found = near_duplicates(prints.select("doc_id", "__fp"), roots=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__fp")).alias("s")
    # By root, as a component whose documents have no id is named by none: of those the smallest fingerprint stays.
    kept = found.groupBy("__root").agg(first).select(F.col("s.doc_id").alias("__id"), F.col("s.__fp").alias("__f"))
    rows = found.groupBy(F.col("doc_id").alias("__id"), F.col("__fp").alias("__f")).agg(F.count("*").alias("__n"))
    kept = kept.join(rows, kept["__id"].eqNullSafe(rows["__id"]) & (kept["__f"] == rows["__f"])).select(kept["__id"], kept["__f"], "__n")
    stay = prints.join(kept, prints["doc_id"].eqNullSafe(kept["__id"]) & (prints["__fp"] == kept["__f"]))
    single, repeated = stay.filter("__n = 1"), stay.filter("__n > 1").dropDuplicates(["__id", "__f"])
    return single.select(*columns).union(repeated.select(*columns))
