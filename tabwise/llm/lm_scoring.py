"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model over lower-cased words (A-Z) and an end token, which
also stands before the first word. Counts are quantised to levels: the level of a
count is the number of thresholds up to it. An n-gram of level q is in a Bloom
filter q times, as (n-gram, 1) to (n-gram, q); its level is read back by repeated
membership probes until one fails. ``BITS`` bits and ``HASHES`` hashes for each
entry make about 2 % of the probes err, always upward.

Probabilities are smoothed by interpolation::

    p(w | v) = LAMBDA * low(v w) / up(v) + (1 - LAMBDA) * (low(w) + 1) / (N + V + 1)

low and up are the smallest and largest count of a level, so that (but for the
filter's errors) the probabilities of all words after v sum to 1 at most.

Jobs. Documents are dealt to blocks by a hash of the row. Each block sends its
distinct words and bigrams with their training counts, packed, to buckets by
n-gram hash; a word that fills a third of the text is one entry of each block.
A bucket sums the counts, answers each block with the exact counts of the words
it asked for (the base score needs them), and builds its region of the filter.
Regions are broadcast in groups of at most ``FILTER_BYTES`` together. If there is
more than one group, all but the last are probed in passes of their own, which
keep a byte for each n-gram (its level), so the result does not depend on the
number of groups and the broadcast is bounded at any corpus size.

Words are compared by a 64-bit hash, bigrams by one of 16 bits more than it
takes to number all tokens: two bigrams collide far less often than the filter errs.

Defined results: null text is empty (one token: the end). Rows for which
``training`` is null train. Without training rows every count is 0 and N + V + 1
is 1. Repeated rows are counted and scored as rows of their own. Other columns
are left out. An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import STEP_BYTES, materialize, mix64, offsets, table, text_bytes
from tabwise.llm.substring_dedup import word_hashes

#: Thresholds in each doubling of a word's count (a bigram's has one); bits and hashes of a filter entry.
WORD_STEPS, BITS, HASHES = 4, 8, 5
LAMBDA = 0.3
#: Text of a block, about; filter bytes broadcast at once, at most (unless one region is larger).
BLOCK_BYTES, FILTER_BYTES = 8 << 20, 128 << 20

_END = np.uint64(0x5851F42D4C957F2D)
_WORD_SALT, _LEVEL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


# --- quantised counts and the filter ---------------------------------------------------------------------------------

@cache
def thresholds(steps: int) -> np.ndarray:
    """Smallest counts of the levels 1, 2, ..: whole numbers next above 2 ** (k / steps)."""
    return np.array(sorted({int(np.ceil(2 ** (k / steps) - 1e-9)) for k in range(steps * 52)}), np.int64)


def level_of(counts: np.ndarray, steps: int) -> np.ndarray:
    return np.searchsorted(thresholds(steps), counts, side="right")


def low_of(levels: np.ndarray, steps: int) -> np.ndarray:
    return np.concatenate([[0], thresholds(steps)])[levels]


def up_of(levels: np.ndarray, steps: int) -> np.ndarray:
    return np.concatenate([[0], thresholds(steps)[1:] - 1, [1 << 60]])[levels]


def _positions(keys: np.ndarray, level: int, bits: int):
    x = mix64(keys ^ np.uint64((int(_LEVEL) * level) % 2**64))
    first, second = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(HASHES):
        yield ((first + np.uint64(i) * second) % np.uint64(bits)).astype(np.int64)


def build_region(groups: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Bloom filter of (keys, levels) groups, each key once for every level up to its own."""
    entries = sum(int(levels.sum()) for _, levels in groups)
    bits = max(64, -(-BITS * entries // 64) * 64)
    field = np.zeros(bits, bool)
    for keys, levels in groups:
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            for place in _positions(keys, level, bits):
                field[place] = True
    return np.packbits(field, bitorder="little").tobytes()


def probe(region: bytes, keys: np.ndarray, most: int) -> np.ndarray:
    """Level of each key: probes of rising level until one fails."""
    field = np.frombuffer(region, np.uint8)
    levels, alive = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for level in range(1, most + 1):
        inside = np.arange(len(alive))
        now = keys[alive]
        for place in _positions(now, level, 8 * len(field)):
            place = place[inside]
            inside = inside[(field[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            if not len(inside):
                break
        if not len(inside):
            break
        alive = alive[inside]
        levels[alive] += 1
    return levels


def _probe_all(regions: dict[int, bytes], keys: np.ndarray, bucket: np.ndarray, steps: int) -> np.ndarray:
    """Levels of keys by bucket; 0 where the bucket's region is not among ``regions``."""
    levels = np.zeros(len(keys), np.uint8)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(int(bucket.max(initial=-1)) + 2))
    for b, region in regions.items():
        if b + 1 < len(edges):
            at = order[edges[b]:edges[b + 1]]
            levels[at] = probe(region, keys[at], min(255, len(thresholds(steps))))
    return levels


# --- blocks ----------------------------------------------------------------------------------------------------------

class Block:
    """Tokens of a block's rows, in an order that depends on the rows alone."""

    def __init__(self, rows: pa.Table, buckets: int, width: int):
        columns = {c: rows.column(c).to_pylist() for c in ("__id", "__train", "__text")}
        order = sorted(range(rows.num_rows), key=lambda i: (columns["__id"][i] is None, columns["__id"][i] or 0, columns["__text"][i]))
        self.ids = [columns["__id"][i] for i in order]
        self.train = np.array([columns["__train"][i] for i in order], bool)
        parts, counts, i = [], [], 0
        texts = [columns["__text"][i] for i in order]
        del columns
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= STEP_BYTES):
                size, j = size + len(texts[j]), j + 1
            words, n = word_hashes([t.lower() for t in texts[i:j]])
            parts.append(words), counts.append(n)
            i = j
        words, n = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((parts, np.uint64), (counts, np.int64)))
        self.n_tokens = n.astype(np.int64) + 1
        self.start = offsets(self.n_tokens)[:-1]
        self.tokens = np.full(len(words) + len(n), _END, np.uint64)
        ends = np.zeros(len(self.tokens), bool)
        ends[np.cumsum(self.n_tokens) - 1] = True
        self.tokens[~ends] = words
        before = np.concatenate([np.full(min(1, len(self.tokens)), _END), self.tokens[:-1]])  # the token before a first word is an end
        self.distinct, self.number = np.unique(self.tokens, return_inverse=True)
        self.word_bucket = (self.distinct % np.uint64(buckets)).astype(np.int64)
        # Words of a bucket lie together, in order of hash.
        self.by_bucket = np.argsort(self.word_bucket, kind="stable")
        self.previous = np.searchsorted(self.distinct, before)
        key = mix64(before * np.uint64(0x9E3779B97F4A7C15) + self.tokens) >> np.uint64(64 - width)
        self.pair_bucket, self.pair = (key % np.uint64(buckets)).astype(np.int64), key // np.uint64(buckets)

    def word_keys(self) -> np.ndarray:
        return mix64(self.distinct ^ _WORD_SALT)

    def levels(self, regions: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the distinct words and of each token's bigram."""
        return (_probe_all(regions, self.word_keys(), self.word_bucket, WORD_STEPS), _probe_all(regions, self.pair, self.pair_bucket, 1))


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their bytes apart: equal high bytes then compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _sorted_planes(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.zeros(1, np.uint64)))


def _from_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


_SENT = "bucket int, block int, words binary, word_counts binary, pairs binary, pair_counts binary"
_SUMMED = "kind int, bucket int, block int, data binary, tokens long, kinds long"
_REPLY, _REGION, _LEVELS = 0, 1, 2


def _send(buckets: int, width: int):
    def run(rows: pa.Table) -> pa.Table:
        number, block = rows.column("block")[0].as_py(), Block(rows, buckets, width)
        train = np.repeat(block.train, block.n_tokens)
        counts = np.bincount(block.number[train], minlength=len(block.distinct))[block.by_bucket]
        words, at = block.distinct[block.by_bucket], np.searchsorted(block.word_bucket[block.by_bucket], np.arange(buckets + 1))
        whole = block.pair[train] * np.uint64(buckets) + block.pair_bucket[train].astype(np.uint64)
        pairs, times = np.unique(whole, return_counts=True)
        bucket = (pairs % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs, times, edge = (pairs // np.uint64(buckets))[order], times[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {k: [] for k in ("bucket", "words", "word_counts", "pairs", "pair_counts")}
        for b in range(buckets):
            w, p = slice(at[b], at[b + 1]), slice(edge[b], edge[b + 1])
            if w.start < w.stop or p.start < p.stop:
                for k, v in zip(out, (b, _sorted_planes(words[w]), _planes(counts[w]), _sorted_planes(pairs[p]), _planes(times[p]))):
                    out[k].append(v)
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array([number] * len(out["bucket"]), pa.int32()),
                         **{k: pa.array(out[k], pa.binary()) for k in ("words", "word_counts", "pairs", "pair_counts")}})
    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return distinct, number, np.bincount(number, np.concatenate([np.zeros(0), *counts]), len(distinct)).astype(np.int64)


def _sum(rows: pa.Table) -> pa.Table:
    column = lambda c, f: [f(x) for x in rows.column(c).to_pylist()]
    asked = column("words", _from_sorted)
    words, number, counts = _totals(asked, column("word_counts", _numbers))
    pairs, _, times = _totals(column("pairs", _from_sorted), column("pair_counts", _numbers))
    region = build_region([(mix64(words ^ _WORD_SALT)[counts > 0], level_of(counts[counts > 0], WORD_STEPS)), (pairs, level_of(times, 1))])
    edge = offsets([len(a) for a in asked])
    replies = [_planes(counts[number[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
    n, bucket = len(replies), rows.column("bucket")[0].as_py()
    return pa.table({"kind": pa.array([_REPLY] * n + [_REGION], pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
                     "block": pa.array([*rows.column("block").to_pylist(), None], pa.int32()),
                     "data": pa.array([*replies, region], pa.binary()), "tokens": pa.array([0] * n + [int(counts.sum())], pa.int64()), "kinds": pa.array([0] * n + [int((counts > 0).sum())], pa.int64())})


def _levels(buckets: int, width: int, shared):
    def run(rows: pa.Table) -> pa.Table:
        words, pairs = Block(rows, buckets, width).levels(shared.value)
        return pa.table({"kind": pa.array([_LEVELS], pa.int32()), "bucket": pa.array([0], pa.int32()), "block": rows.column("block")[:1].cast(pa.int32()),
                         "data": pa.array([np.concatenate([words, pairs]).tobytes()], pa.binary()), "tokens": pa.array([0], pa.int64()), "kinds": pa.array([0], pa.int64())})
    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, width: int, shared, n: int, v: int, weight: float):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows, buckets, width)
        kinds, numbers, data = (answers.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        replies = sorted((b, x) for k, b, x in zip(kinds, numbers, data) if k == _REPLY)
        counts = np.empty(len(block.distinct), np.int64)
        counts[block.by_bucket] = np.concatenate([np.zeros(0, np.uint64), *(_numbers(x) for _, x in replies)]).astype(np.int64)
        words, pairs = block.levels(shared.value)
        for k, x in zip(kinds, data):
            if k == _LEVELS:
                found = np.frombuffer(x, np.uint8)
                words, pairs = words + found[: len(words)], pairs + found[len(words):]
        one = (low_of(words, WORD_STEPS) + 1) / (n + v + 1)
        after = low_of(pairs, 1) / np.maximum(up_of(words, WORD_STEPS), 1)[block.previous]
        # A false hit of the filter may be larger than its context's count: no word is surer than sure.
        p = weight * np.minimum(after, 1.0) + (1 - weight) * one[block.number]
        add = lambda x: np.add.reduceat(x, block.start) if len(block.start) else np.zeros(0)
        base = add(np.log10(counts + 1.0)[block.number]) - block.n_tokens * np.log10(n + v + 1)
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "held_out": ~block.train, "n_tokens": block.n_tokens, "n_known": add((counts > 0).astype(np.int64)[block.number]).astype(np.int64),
                         "train_tokens": np.full(len(block.ids), n, np.int64), "base_score": base, "score": add(np.log10(p))})
    return run


# --- the operator ----------------------------------------------------------------------------------------------------

def lm_scores(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", weight: float = LAMBDA, filter_bytes: int = FILTER_BYTES,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows where ``training`` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(training, F.lit(True)).alias("__train"), text_bytes(F.col(text)).alias("__text"))
    size = int(rows.agg(F.sum(F.length("__text") + 2)).first()[0] or 0)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = max(least, -(-size // block_bytes)), max(least, -(-size // (2 * block_bytes)))
    width = min(64, 16 + max(1, size // 2).bit_length())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)).cast("int"))
    sent = rows.groupBy("block").applyInArrow(_send(buckets, width), _SENT)
    summed = materialize(sent.groupBy("bucket").applyInArrow(_sum, _SUMMED), "lm-counts")
    totals = summed.filter(F.col("kind") == _REGION).agg(F.sum("tokens"), F.sum("kinds")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)

    # Regions by groups of bounded size; the driver holds one group at a time.
    sizes = summed.filter(F.col("kind") == _REGION).select("bucket", F.length("data").alias("n")).orderBy("bucket").collect()
    groups, held = [[]], 0
    for r in sizes:
        if groups[-1] and held + r.n > filter_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r.bucket)
        held += r.n
    answers = summed.filter(F.col("kind") == _REPLY)
    for i, group in enumerate(groups):
        regions = summed.filter((F.col("kind") == _REGION) & F.col("bucket").between(min(group, default=0), max(group, default=-1))).select("bucket", "data")
        shared = spark.sparkContext.broadcast({r.bucket: bytes(r.data) for r in regions.toLocalIterator()})
        if i < len(groups) - 1:
            answers = answers.union(materialize(rows.groupBy("block").applyInArrow(_levels(buckets, width, shared), _SUMMED), "lm-levels"))
            shared.destroy()
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, width, shared, n, v, weight), _SCORED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those outside the held-out seventh."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold != 2)
