import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwise.llm import packing
from tabwise.llm.tokens import tokenizer_file


def _optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {bins[b]: b for b in range(len(bins)) if bins[b] + items[i] <= capacity}.values():
            bins[b] += items[i]
            go(i + 1, bins)
            bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])
    go(0, [])
    return best[0]


def _pieces(plan):
    got = {}
    for times, pieces in plan:
        for p in pieces:
            got[p] = got.get(p, 0) + times
    return got


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_plan_is_optimal_on_small_cases(case):
    capacity, items = case
    histogram = {x: items.count(x) for x in items}
    plan = packing.bin_completion(histogram, capacity)
    assert _pieces(plan) == histogram and all(sum(p) <= capacity and t > 0 for t, p in plan)
    assert sum(t for t, _ in plan) == _optimum(items, capacity)


def test_completion_beats_best_fit_and_counts_scale():
    assert sum(t for t, _ in packing.first_fit_decreasing({6: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 14)) >= 2
    r = random.Random(3)
    histogram = {}
    for _ in range(20_000):
        x = min(2048, max(2, int(r.lognormvariate(6.3, 1))))
        histogram[x] = histogram.get(x, 0) + 1
    plan = packing.bin_completion(histogram, 2048)
    n, bound = sum(t for t, _ in plan), -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert _pieces(plan) == histogram and n <= sum(t for t, _ in packing.first_fit_decreasing(histogram, 2048)) and n <= bound * 1.002 + 1
    big = packing.bin_completion({k: v * 10**6 for k, v in histogram.items()}, 2048)
    assert _pieces(big) == {k: v * 10**6 for k, v in histogram.items()} and len(big) < 10 * 2048


def test_lengths_out_of_range():
    for bad in ({0: 1}, {9: 1}):
        with pytest.raises(ValueError):
            packing.bin_completion(bad, 8)


def _gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048 or at <= 16
    return len(by)


def test_pack_handles_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)  # one length over several shards
    rows = [(i % 9, 5, "hot", 1) for i in range(60)] + [(i, i % 16 + 1, None, 2) for i in range(40)] + [(None, None, "x", 3), (1, 0, "y", 4)]
    df = spark.createDataFrame(rows, "id long, length long, sequence_id string, __x int")
    got = packing.pack(df, capacity=16).collect()
    assert sorted(((r.id, r.length, r["__x"]) for r in got), key=str) == sorted(((a, b, d) for a, b, _, d in rows), key=str)
    assert all((r.sequence_id is None) == (not r.length) for r in got)
    packed = [r for r in got if r.length]
    histogram = {}
    for r in packed:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    assert _gapless(packed) == sum(t for t, _ in packing.bin_completion(histogram, 16))
    assert packing.pack(df.filter(F.lit(False)), capacity=16).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=4)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(tokenizer_file())
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want.add((r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.op4_best_fit_packing(spark, sf).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    n, tokens = _gapless(got), sum(r.length for r in got)
    assert n <= -(-tokens // 2048) + 1


def test_pieces_carry_ids(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, None), (None, "")], "doc_id long, text string")
    got = packing.token_pieces(docs, with_ids=True).collect()
    assert sorted(((r.doc_id, r.piece, r.length) for r in got), key=str) == sorted([(1, 0, 2048), (1, 1, 2048), (1, 2, 905), (2, 0, 1), (None, 0, 1)], key=str)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
