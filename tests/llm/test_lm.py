import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise.llm import lm_scoring as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</end>"]


def _brute(rows, training):
    """Base columns, and the score of the same model with quantised counts but without a filter."""
    words, pairs = Counter(), Counter()
    for row in rows:
        if training(row):
            t = _tokens(row[1])
            words.update(t)
            pairs.update(zip(["</end>", *t], t))
    n, v = sum(words.values()), len(words)
    level = lambda c, s: int(lm.level_of(np.array([c]), s)[0])
    low = lambda c, s: int(lm.low_of(np.array([level(c, s)]), s)[0])
    up = lambda c, s: int(lm.up_of(np.array([level(c, s)]), s)[0])
    out = []
    for row in rows:
        t = _tokens(row[1])
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(lm.LAMBDA * low(pairs[a, w], 1) / max(1, up(words[a], lm.WORD_STEPS)) + (1 - lm.LAMBDA) * (low(words[w], lm.WORD_STEPS) + 1) / (n + v + 1))
                    for a, w in zip(["</end>", *t], t))
        out.append((row[0], not training(row), len(t), sum(words[w] > 0 for w in t), n, base, score))
    return out


def _same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[5])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    return np.array([r[6] for r in got]), np.array([r[6] for r in want])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10**12), max_size=60), st.sampled_from([1, 4]))
def test_levels_bound_counts_and_filter_never_underrates(counts, steps):
    counts = np.array(counts, np.int64)
    levels = lm.level_of(counts, steps)
    assert (lm.low_of(levels, steps) <= counts).all() and (counts <= lm.up_of(levels, steps)).all()
    keys = np.arange(len(counts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (lm.probe(lm.build_region([(keys, levels)]), keys, 255) >= levels).all()


def test_filter_errs_seldom():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 40_000).astype(np.uint64)
    region = lm.build_region([(keys[:20_000], np.ones(20_000, np.int64))])
    assert (lm.probe(region, keys[20_000:], 255) > 0).mean() < 0.03


def test_probabilities_sum_to_one_at_most():
    """After any known word, over all known words and one unknown, without filter errors."""
    r = np.random.default_rng(2)
    tokens = [t for _ in range(40) for t in _tokens(" ".join(f"w{i}" for i in r.zipf(1.4, 60) % 50))]
    words, pairs, n = Counter(tokens), Counter(zip(tokens, tokens[1:])), len(tokens)
    quantised = lambda f, c, s: int(f(lm.level_of(np.array([c]), s), s)[0])
    for v in words:
        after = sum(quantised(lm.low_of, pairs[v, w], 1) for w in words) / quantised(lm.up_of, words[v], lm.WORD_STEPS)
        one = sum((quantised(lm.low_of, c, lm.WORD_STEPS) + 1) / (n + len(words) + 1) for c in words.values()) + 1 / (n + len(words) + 1)
        assert lm.LAMBDA * after + (1 - lm.LAMBDA) * one <= 1 + 1e-12


def _rows():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "The", "the", "x" * 400]
    return [(i * 7 - 90, " ".join(vocabulary[j] for j in r.zipf(1.3, r.integers(0, 80)) % len(vocabulary))) for i in range(400)] + [
        (None, "The null ID"), (None, None), (-90, "repeated row"), (-90, "repeated row"), (5000, ""), (5001, "never seen words only"), (5002, "a\tB\x0bc\x1cd \n")]


def _train(row):
    return row[0] is None or zlib.crc32(str(row[0]).encode()) % 7 != 2


@pytest.mark.parametrize("options", [{}, {"filter_bytes": 1200, "block_bytes": 5000}])
def test_scores_equal_brute_force(spark, options):
    rows = _rows()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, block string, score int").repartition(4)
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7
    got = [tuple(r) for r in lm.lm_scores(df, fold != 2, **options).collect()]
    found, exact = _same(got, _brute(rows, _train))
    # The filter errs upward only, but a larger context lowers a probability; on the whole the scores agree.
    assert np.abs(found - exact).sum() < 0.05 * np.abs(exact).sum() and (np.abs(found - exact) < 1e-9).mean() > 0.1


def test_groups_of_regions_do_not_matter(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string")
    a, b = (sorted(map(tuple, lm.lm_scores(df, F.col("doc_id") % 2 == 0, filter_bytes=n).collect()), key=str) for n in (1 << 30, 2000))
    assert a == b


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame(_rows()[:20], "doc_id long, text string")
    got = lm.lm_scores(df, F.lit(False)).collect()
    assert len(got) == 20 and all(r.train_tokens == 0 and r.base_score == 0 and r.held_out and r.n_known == 0 for r in got)
    assert lm.lm_scores(df.filter(F.lit(False)), F.lit(True)).count() == 0


def test_registered_query_beats_base_on_held_out(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in lm.op3_lm_scoring(spark, sf).collect()]
    _same(got, _brute(rows, _train))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)
