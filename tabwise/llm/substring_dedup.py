"""Substring dedup by seed and extend.

A *window* is ``min_words`` consecutive words of a document. A window is a
repeat if its words also start earlier: in a document that comes before (smaller
doc_id), or earlier in the same one. Words covered by a repeat go.

Seeds. Of the ``seed``-word sequences of a window the one with the smallest hash
is its anchor (winnowing), so equal windows have their anchor at the same place.
An occurrence of an anchor stands for the run of windows that chose it.

Extend, first step. An occurrence is extended left and right over its whole run;
a hash of that stretch names its class. All members of a class but the earliest
are repeats in full. Each task reduces its own classes before the shuffle, so a
passage that fills a third of the corpus sends one row from each task. Anchors
are joined in buckets (packed arrays, not rows).

Extend, second step. An anchor of which several classes exist (the ends of a
passage, or an edit close by) needs its windows one by one: of each class only
the earliest member is asked for, its windows are hashed (128 bits) from the
text, and all but the earliest equal window are repeats. That is linear in the
windows asked for, no pairs are formed. Anchors that fill much of a bounded
sample of documents (``HEAVY``) skip the join by anchor and spread over all
buckets by class; the sample decides on the route only, never on the result.

Repeats that touch or overlap are united: the maximal repeats of at least
``min_words`` words.

Defined results: null text has no words. Rows without an id come after all
others. Rows with one id are ordered by the hash of their text; rows alike in id
and text are one document and get the same result. Other columns pass through,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.llm.common import materialize, mix64, offsets, set_aside, steps, table, text_bytes

MIN_WORDS, SEED = 20, 8
#: Bytes of text whose anchors a task reduces together, and at most so many bytes of text for each bucket.
FLUSH_BYTES, BUCKET_BYTES = 12 << 20, 128 << 20
#: Documents of the sample for heavy anchors, bytes read of each of them, share of the sample's classes from which an anchor is heavy.
HEAVY_SAMPLE, HEAVY_BYTES, HEAVY = 2_000, 1 << 16, 1 / 500

_LAST = np.iinfo(np.int64).max
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).copy()
_BYTE[_SPACE] = 0
_M, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

ANCHOR = np.dtype([("anchor", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("at", "<i4"), ("before", "u1"), ("run", "u1")])
WINDOW = np.dtype([("anchor", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("at", "<i4")])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    ends = offsets([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    longest = int(np.diff(np.concatenate([starts, [len(data)]])).max())
    values = _BYTE[data]
    values *= _powers(_M, max(longest, int(starts[0])) + 1)[place]
    return mix64(np.add.reduceat(values, starts)), counts


def sequence_hashes(words: np.ndarray, at: np.ndarray, n: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of the n words from each place."""
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total *= multiplier
        total += words[at + j]
    return mix64(total)


def anchors(words: np.ndarray, counts: np.ndarray, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ANCHOR rows without document, document number of each) of the texts' winnowed anchors; places count from the text's start."""
    ends = offsets(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if n < min_words:
        return np.zeros(0, ANCHOR), np.zeros(0, np.int64)
    seeds = sequence_hashes(words, np.arange(n - seed + 1), seed, _M)
    reach = min_words - seed + 1
    windows = np.lib.stride_tricks.sliding_window_view(seeds, reach)
    start = np.flatnonzero(doc[: n - min_words + 1] == doc[min_words - 1:])
    chosen = np.empty(len(windows), np.int64)
    for i in range(0, len(windows), 1 << 18):
        chosen[i:i + (1 << 18)] = windows[i:i + (1 << 18)].argmin(axis=1)
    chosen = start + chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.concatenate([low[1:], [len(start)]]) - 1
    out = np.zeros(len(low), ANCHOR)
    if not len(low):
        return out, np.zeros(0, np.int64)
    at = chosen[low]
    # Hash of the whole stretch from sums of word * M**place, moved to place 0.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_M2, n), dtype=np.uint64)])
    back = _powers(np.uint64(pow(int(_M2), -1, 1 << 64)), n)
    out["anchor"], out["span"] = seeds[at], mix64((sums[start[high] + min_words] - sums[start[low]]) * back[start[low]])
    out["at"], out["before"], out["run"] = at - ends[doc[at]], at - start[low], start[high] - start[low]
    return out, doc[at]


def _same(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether each row equals the one before it in the named fields."""
    same = np.zeros(len(rows), bool)
    if len(rows) > 1:
        same[1:] = np.logical_and.reduce([rows[n][1:] == rows[n][:-1] for n in names])
    return same


_CLASS = ("anchor", "span", "before", "run")


def by_class(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each once, sorted by anchor, class and place in the corpus, and which of them are the first of their class.

    Rows alike in everything come from repeated rows of the input, which count as one document.
    """
    names = [n for n in ("at", "sub", "doc", "run", "before", "span", "anchor") if n in rows.dtype.names]
    rows = rows[np.lexsort([rows[n] for n in names])]
    rows = rows[~_same(rows, *names)]
    return rows, ~_same(rows, *(n for n in _CLASS if n in rows.dtype.names))


def _ranges(rows: np.ndarray) -> pa.RecordBatch:
    """Repeats: windows starting from low to high."""
    low = rows["at"].astype(np.int64) - (rows["before"] if "before" in rows.dtype.names else 0)
    return _out(rows, low, low + (rows["run"] if "run" in rows.dtype.names else 0), False)


def _out(rows, low, high, ask: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["sub"]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                                       pa.array(np.full(len(rows), ask))], names=["doc", "sub", "low", "high", "ask"])


_RANGE = "doc long, sub long, low int, high int, ask boolean"
_BLOB = "bucket int, kind int, rows binary"


def _blobs(kind: int, rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One packed array for each bucket, its fields' bytes apart (equal high bytes then compress)."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, np.int64)
    parts = np.split(rows, edges[1:]) if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), pa.array(np.full(len(parts), kind), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())],
                                      names=["bucket", "kind", "rows"])


def _pack(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind) for b in blobs]
    return np.concatenate([np.zeros(0, kind), *parts])


_DECIDED, _JOIN, _HEAVY = 0, 1, 2


def _seeds(buckets: int, min_words: int, seed: int, heavy: np.ndarray):
    """Task: texts to packed anchors for each bucket; repeats found within the task go along as decided."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, first = by_class(np.concatenate(held))
        yield _blobs(_DECIDED, rows[~first], (rows["doc"][~first] % buckets).astype(np.int32))
        rows = rows[first]
        hot = np.isin(rows["anchor"], heavy)
        yield _blobs(_JOIN, rows[~hot], (rows["anchor"][~hot] % np.uint64(buckets)).astype(np.int32))
        yield _blobs(_HEAVY, rows[hot], (rows["span"][hot] % np.uint64(buckets)).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in steps(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            rows, doc = anchors(*word_hashes(texts), min_words, seed)
            rows["doc"], rows["sub"] = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("__doc", "__sub"))
            held.append(rows)
            size += sum(map(len, texts))
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _extend(group: pa.Table) -> pa.Table:
    """A bucket: later members of a class are repeats; the first ones of anchors with several classes are asked for."""
    kinds, blobs, out = group.column("kind").to_numpy(), group.column("rows").to_pylist(), []
    of = lambda kind: _unpack([b for b, k in zip(blobs, kinds) if k == kind], ANCHOR)
    out.append(_ranges(of(_DECIDED)))
    for kind in (_JOIN, _HEAVY):
        rows, first = by_class(of(kind))
        out.append(_ranges(rows[~first]))
        rows = rows[first]
        if kind == _JOIN:
            twin = _same(rows, "anchor")
            twin[:-1] |= twin[1:]
            rows = rows[twin]
        low = rows["at"].astype(np.int64) - rows["before"]
        out.append(_out(rows, low, low + rows["run"], True))
    return pa.Table.from_batches(out)


def _asked_windows(buckets: int, min_words: int):
    """Task: texts and the windows asked for of each to packed window hashes for each bucket."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, first = by_class(np.concatenate(held))
        yield _blobs(_DECIDED, rows[~first], (rows["doc"][~first] % buckets).astype(np.int32))
        yield _blobs(_JOIN, rows[first], (rows["span"][first] % np.uint64(buckets)).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in steps(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            words, counts = word_hashes(texts)
            begin = offsets(counts)
            lists = batch.column("ranges")
            n_asked, pairs = np.diff(np.asarray(lists.offsets)), lists.flatten()
            low, high = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            doc = np.repeat(np.arange(len(texts)), n_asked)
            run_length = high - low + 1
            start = np.arange(int(run_length.sum())) + np.repeat(low - (np.cumsum(run_length) - run_length), run_length)
            doc = np.repeat(doc, run_length)
            rows = np.zeros(len(start), WINDOW)
            at = start + begin[doc]
            rows["anchor"], rows["span"] = (sequence_hashes(words, at, min_words, m) for m in (_M, _M2))
            rows["at"] = start
            rows["doc"], rows["sub"] = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("__doc", "__sub"))
            held.append(rows)
            size += len(rows) * 32 + sum(map(len, texts)) // 8
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _equal_windows(group: pa.Table) -> pa.Table:
    kinds, blobs = group.column("kind").to_numpy(), group.column("rows").to_pylist()
    rows, first = by_class(_unpack([b for b, k in zip(blobs, kinds) if k == _JOIN], WINDOW))
    return pa.Table.from_batches([_ranges(_unpack([b for b, k in zip(blobs, kinds) if k == _DECIDED], WINDOW)), _ranges(rows[~first])])


def _heavy_anchors(docs: DataFrame, min_words: int, seed: int) -> np.ndarray:
    """Anchors with many classes in a bounded sample: at most HEAVY_SAMPLE documents of HEAVY_BYTES, at most 1 / HEAVY anchors."""
    some = (docs.select("__doc", "__sub").orderBy(F.xxhash64("__doc", "__sub")).limit(HEAVY_SAMPLE))
    texts = docs.join(F.broadcast(some.distinct()), ["__doc", "__sub"], "left_semi").select(F.substring("__text", 1, HEAVY_BYTES).alias("t")).limit(HEAVY_SAMPLE)
    found = [r.t for r in texts.toLocalIterator()]
    rows, _ = anchors(*word_hashes(found), min_words, seed)
    rows, first = by_class(rows)
    values, n = np.unique(rows["anchor"][first], return_counts=True)
    return values[n > max(50, HEAVY * int(first.sum()))]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with __doc, __sub (place in the corpus) and __text (bytes). __sub is 0 for an id that occurs once."""
    twice = docs.groupBy(F.col(doc_id).alias("__id")).count().filter("count > 1 AND __id IS NOT NULL").select("__id", F.lit(True).alias("__twice"))
    twice = materialize(twice, "repeated-ids")
    twice = twice.limit(0) if twice.isEmpty() else twice  # then the join is planned away
    joined = docs.join(twice, docs[doc_id] == twice["__id"], "left").drop("__id")
    content = text_bytes(F.col(text))
    sub = F.when(F.col(doc_id).isNull() | F.col("__twice"), F.xxhash64(content)).otherwise(F.lit(0).cast("long"))
    return joined.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST))), "__sub": sub, "__text": content}).drop("__twice")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc, sub, ranges) of every document of ``keyed(docs)`` with repeats; ranges: first and last window start."""
    if not 1 <= seed <= min_words or min_words - seed > 255:
        raise ValueError("seed must be 1 to min_words, and at most 255 shorter")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("__text")), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size[0] or 0) // BUCKET_BYTES))
    heavy = _heavy_anchors(docs, min_words, seed)
    source = docs.select("__doc", "__sub", "__text")
    packed = source.mapInArrow(_seeds(buckets, min_words, seed, heavy), _BLOB)
    first = materialize(packed.groupBy("bucket").applyInArrow(_extend, _RANGE), "extended")
    asked = first.filter("ask").groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    texts = source.join(asked, (source["__doc"] == asked["doc"]) & (source["__sub"] == asked["sub"])).select("__doc", "__sub", "__text", "ranges")
    packed = texts.mapInArrow(_asked_windows(buckets, min_words), _BLOB)
    second = packed.groupBy("bucket").applyInArrow(_equal_windows, _RANGE)
    found = first.filter("NOT ask").union(second)
    return found.groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def covered(n_words: int, low: np.ndarray, high: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + min_words, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, seed: int = SEED,
                    keep: list[str] | None = None, new_text: bool = True) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row, __n_words, __n_removed, __kept_sha256 (of the kept words, joined by one
    space), __spans (first and last word of each maximal repeat), and with new_text __kept: the text without the removed words, else as it was."""
    names = docs.columns if keep is None else keep
    source = keyed(docs, doc_id, text)
    found = repeats(source, min_words, seed)
    source = source.select("__doc", "__sub", "__text", *(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)))
    joined = source.join(found, (source["__doc"] == found["doc"]) & (source["__sub"] == found["sub"]), "left").drop("__doc", "__sub", "doc", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            n_words, n_removed, digests, spans, kept = [], [], [], [], []
            lists = batch.column("ranges")
            at, pairs = np.asarray(lists.offsets), lists.values
            low, high = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i, content in enumerate(batch.column("__text").to_pylist()):
                words, gone = content.split(), None
                if lists[i].is_valid:
                    gone = covered(len(words), low[at[i]:at[i + 1]], high[at[i]:at[i + 1]], min_words)
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                edge = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])])
                if new_text:
                    kept.append(content if gone is None else _cut(content, gone))
            out = [*(batch.column(f"__c{i}") for i in range(len(names))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
                   pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            columns = [*names, "__n_words", "__n_removed", "__kept_sha256", "__spans"]
            if new_text:
                out, columns = [*out, pa.array(kept, pa.binary())], [*columns, "__kept"]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    schema = docs.select(*names).schema.add("__n_words", "long").add("__n_removed", "long").add("__kept_sha256", "string")
    schema = schema.add("__spans", T.ArrayType(T.StructType().add("first", "integer").add("last", "integer")))
    return joined.mapInArrow(run, schema.add("__kept", "binary") if new_text else schema)


def _cut(content: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each with the white space after it."""
    starts = [m.start() for m in _WORD.finditer(content)]
    ends = [*starts[1:], len(content)]
    return b"".join(content[a:b] for a, b, g in zip([0, *starts[1:]], ends, gone.tolist()) if not g)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], new_text=False)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text without repeated passages; n_chars, if there, follows."""
    docs, columns = set_aside(docs, ("doc_id", "text", "n_chars"))
    new = F.when(F.col("__n_removed") > 0, F.decode("__kept", "utf-8")).otherwise(F.col("text"))
    out = without_repeats(docs).withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w)::BIGINT)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, i + {MIN_WORDS - 1} <= len(w) AS whole, array_to_string(w[i:i+{MIN_WORDS - 1}], ' ') AS s FROM p),
r AS (SELECT doc_id, i, word, whole AND row_number() OVER (PARTITION BY whole, s ORDER BY doc_id, i) > 1 AS again FROM k),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS {MIN_WORDS - 1} PRECEDING) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
