import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise.llm import source_mixing as sm

TOKENS = st.lists(st.integers(1, 10**6).map(float), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(TOKENS, st.floats(0.5, 1.0), st.floats(1.0, 20.0))
def test_exponent_meets_target_and_limit(tokens, target, limit):
    a = sm.find_exponent(tokens, target, None)
    w, wanted = sm.weights(tokens, a), target * math.log(len(tokens))
    assert 0 <= a <= 1 and math.isclose(sum(w), 1)
    natural = sm.entropy(sm.weights(tokens, 1.0))
    assert sm.entropy(w) == pytest.approx(max(natural, wanted), abs=1e-6) if a else sm.entropy(w) <= wanted + 1e-9 or natural >= wanted - 1e-9
    b = sm.find_exponent(tokens, target, limit)
    assert b >= a - 1e-12
    often = sm.repeats(tokens, sm.weights(tokens, b), None)
    assert min(often) == 1.0 and (max(often) <= limit * (1 + 1e-9) or b == 1.0)
    if b > a + 1e-9:
        assert max(often) == pytest.approx(limit, rel=1e-6)


def test_edges_of_the_search():
    assert sm.find_exponent([], 0.9, 2) == 1.0 and sm.find_exponent([0.0, 0.0], 0.9, 2) == 1.0
    assert sm.find_exponent([5.0, 1.0], None, None) == 1.0 and sm.find_exponent([5.0, 1.0], 2.0, None) == 0.0
    assert sm.find_exponent([5.0, 1.0], None, 100.0) == 0.0
    assert sm.weights([3.0, 0.0, 1.0], 0.0) == [0.5, 0.0, 0.5]


def _unit(epoch, key):
    return int(hashlib.md5(f"17|{epoch}|{key}".encode()).hexdigest()[:15], 16)


def _brute(rows, **targets):
    docs = []
    for doc_id, text, source in rows:
        key = f"{'null' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
        docs.append((doc_id, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), key))
    sources = sorted({d[1] for d in docs}, key=str)
    tokens = [float(sum(d[2] for d in docs if d[1] == s)) for s in sources]
    budget = targets.get("budget")
    shares = sm.weights(tokens, sm.find_exponent(tokens, targets.get("target_entropy", sm.TARGET_ENTROPY), targets.get("max_repeats", sm.MAX_REPEATS), budget))
    out = []
    for s, t, often in zip(sources, tokens, sm.repeats(tokens, shares, budget)):
        often = often if t else 1.0
        whole = int(often + 1e-9)
        rest = (often - whole) * t
        mine = sorted((_unit(whole, d[3]), d) for d in docs if d[1] == s)
        for u, d in mine:
            part = rest > 0 and sum(x[2] for v, x in mine if v <= u) <= rest
            out += [(d[0], s, d[2], e, round((e + _unit(e, d[3]) / 16.0**15) / often, 9)) for e in range(whole + part)]
    return out


ROWS = ([(i, "word " * (i % 23 + 1), "big") for i in range(300)] + [(400 + i, "a b c d " * (i % 5), "mid") for i in range(60)] + [(500 + i, "x\ty", "small") for i in range(20)]
        + [(None, "no id", None), (None, "no id", None), (7, None, None), (8, "", "empty"), (9, None, "empty"), (1, "word word", "big"), (1, "word word", "big")])


@pytest.mark.parametrize("targets", [{}, {"max_repeats": 3.5, "target_entropy": 1.0}, {"max_repeats": None, "target_entropy": 0.8}, {"budget": 900.0, "max_repeats": 4.0},
                                     {"budget": 20000.0, "max_repeats": None}])
def test_mix_equals_brute_force(spark, monkeypatch, targets):
    monkeypatch.setattr(sm, "BLOCKS", 16)
    df = spark.createDataFrame([(i, t, s, 1, "p", 0.5) for i, t, s in ROWS], "doc_id long, text string, source string, epoch int, s string, place double").repartition(4)
    got = sm.mix(df, **targets)
    assert got.columns == ["doc_id", "text", "source", "s", "n_tokens", "epoch", "place"]
    got = [(r.doc_id, r.source, r.n_tokens, r.epoch, round(r.place, 9)) for r in got.collect()]
    assert sorted(got, key=str) == sorted(_brute(ROWS, **targets), key=str)
    if not targets.get("budget"):
        assert len({(r[0], r[1]) for r in got}) == len({(i, s) for i, _, s in ROWS})


def test_empty_and_too_many_sources(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert sm.mix(df.filter(F.lit(False))).count() == 0
    assert sorted(r.doc_id for r in sm.mix(df.filter("source = 'empty'")).collect()) == [8, 9]
    monkeypatch.setattr(sm, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        sm.mix(df)


def test_stage_keeps_every_document(spark):
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    got = sm.stage(spark, df, "")
    assert got.columns == df.columns and got.select("doc_id", "source").distinct().count() == df.select("doc_id", "source").distinct().count() and got.count() > df.count()
