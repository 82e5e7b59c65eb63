"""Quality rules with suffix-array repetition.

A document's words are numbered, its suffix array is built by prefix doubling
(several documents of one step at once; a suffix never compares equal across
documents), and the longest common prefixes of neighbouring suffixes give the
LCP intervals, that is the maximal repeated word sequences. The spans of all
repeats of at least ``min_repeat`` words are united. The method rejects a
document if the united spans cover more than ``max_covered`` of its words, or if
its longest repeat has more than ``max_longest`` words.

Prefix doubling sorts only the suffixes that are not yet unique, so the work
follows the repeated part of a text. Memory is bounded by ``STEP_BYTES`` of text,
or by the one longer text that forms its own step.

Defined results: a null or empty text has zero counts, fails the base rules and
is not kept. Repeated rows get equal results, row by row. Other columns pass
through ``apply_rules``; a column of one of the result's names is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import offsets, set_aside, steps, table, text_bytes

#: Words of the shortest repeat that counts, most of the words that repeats may cover, words of the longest repeat allowed.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 200
#: Base rules: fewest words, largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
RESULTS = (*COUNTS, "base_failed", "kept", "__text")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD_CHAR = np.ones(256, np.int64)  # the first byte of a code point that is no separator
_WORD_CHAR[0x80:0xC0] = 0
_WORD_CHAR[[0x20, *range(0x09, 0x0E)]] = 0


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with the same key."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def longest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest sequence from there that also starts elsewhere in the same document.

    doc: document of each position (ascending), word: number of its word. This
    is the larger of the two LCP values beside the suffix in its document's
    suffix array, the deepest LCP interval that holds it.
    """
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64)
    # A class (equal first 2**k words) is named by the place of its first suffix in the sorted order.
    # Positions whose class is alone are not sorted again.
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _heads(key[order])
    levels, width, active = [rank], 1, _shared(rank, np.arange(n))
    while len(active):
        after = active + width
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[active[inside]]
        # 0: the suffix ends here; it sorts first and no other of its class (one document) ends here.
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[after[inside]] + 1
        key = rank[active] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, head = active[order], rank[active[order]]
        rank = rank.copy()
        rank[at] = head + _heads(key[order]) - _heads(head)
        levels.append(rank)
        active = _shared(rank, active)
        width *= 2
    suffix = np.argsort(rank, kind="stable")
    i, j = suffix[:-1].copy(), suffix[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((i < n) & (j < n))
        same = ok[levels[k][i[ok]] == levels[k][j[ok]]]
        lcp[same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    out = np.zeros(n, np.int64)
    if n > 1:
        out[suffix[:-1]] = lcp
        out[suffix[1:]] = np.maximum(out[suffix[1:]], lcp)
    return out


def _shared(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those positions whose class has another member."""
    order = np.argsort(rank[among], kind="stable")
    r = rank[among][order]
    same = r[1:] == r[:-1]
    twin = np.zeros(len(r), bool)
    twin[1:] |= same
    twin[:-1] |= same
    return np.sort(among[order[twin]])


def _covered(starts: np.ndarray, spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span of ``spans`` positions from ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + spans, -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The columns of ``COUNTS`` for whole texts."""
    numbers: dict[bytes, int] = {}
    rows, dup_lines = [], []
    for text in texts:
        words = text.split()
        rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
    n_words = np.array([len(r) for r in rows], np.int64)
    at, word = offsets(n_words), np.concatenate([*rows, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(texts)), n_words)
    per_doc = lambda values: np.diff(offsets(values)[at])
    byte_at, data = offsets([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    longest = longest_repeats(doc, word)
    three, far = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_repeat)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, longest)
    return {
        "n_words": n_words,
        "word_chars": np.diff(offsets(_WORD_CHAR[data])[byte_at]),
        "n_symbols": np.diff(offsets(_SYMBOL[data])[byte_at]),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": per_doc(_covered(three, longest[three], len(word))),
        "covered_words": per_doc(_covered(far, longest[far], len(word))),
        "longest_repeat": top,
    }


def _measured(min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            found = measure(batch.column("__text").to_pylist(), min_repeat)
            kept = [batch.column(c) for c in batch.schema.names if c != "__text"]
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[c]) for c in COUNTS)], names=[*names, *COUNTS])
    return run


def apply_rules(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` with the columns of ``COUNTS``, base_failed and kept."""
    if min_repeat < 3:
        raise ValueError("min_repeat must be 3 at least")
    docs = docs.drop(*(c for c in RESULTS if c != text))
    inner = docs.withColumn("__text", text_bytes(F.col(text)))
    schema = docs.schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    # `word in a repeated 3-word window` is `covered by a repeat of 3 words or more`: one suffix array serves both rules.
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return (inner.mapInArrow(_measured(min_repeat), schema)
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Only the id goes through Python beside the text.
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "covered_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    docs, columns = set_aside(docs, ("doc_id", "text"))
    return apply_rules(docs).filter("kept").select(*columns)


#: Windows of k words found twice cover what repeats of k words or more cover; a longest repeat over m is an (m + 1)-word window found twice.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w)::BIGINT)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS a, array_to_string(w[i:i+{MIN_REPEAT - 1}], ' ') AS b, array_to_string(w[i:i+{MAX_LONGEST}], ' ') AS c,
             i + 2 <= len(w) AS ha, i + {MIN_REPEAT - 1} <= len(w) AS hb, i + {MAX_LONGEST} <= len(w) AS hc FROM p),
t AS (SELECT doc_id, i, ha AND count(*) OVER (PARTITION BY doc_id, ha, a) > 1 AS ta, hb AND count(*) OVER (PARTITION BY doc_id, hb, b) > 1 AS tb,
             hc AND count(*) OVER (PARTITION BY doc_id, hc, c) > 1 AS tc FROM k),
u AS (SELECT doc_id, bool_or(ta) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS ua,
             bool_or(tb) OVER (PARTITION BY doc_id ORDER BY i ROWS {MIN_REPEAT - 1} PRECEDING) AS ub, tc FROM t),
s AS (SELECT doc_id, count(*) FILTER (ua) AS n_repeat_words, count(*) FILTER (ub) AS covered_words, bool_or(tc) AS long FROM u GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
               - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long, false) AS long
      FROM d LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
       NOT base_failed AND covered_words <= {MAX_COVERED}::DOUBLE * n_words AND NOT long AS kept FROM f
"""
