import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import substring_dedup as sub


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _brute(rows, min_words):
    """(words, marks) for rows in corpus order."""
    seen, out = set(), []
    for text in rows:
        words = _words(text)
        gone = [False] * len(words)
        for i in range(len(words) - min_words + 1):
            window = tuple(words[i:i + min_words])
            if window in seen:
                gone[i:i + min_words] = [True] * min_words
            seen.add(window)
        out.append((words, gone))
    return out


def _want(rows, min_words):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for (doc_id, _), (words, gone) in zip(ordered, _brute([t for _, t in ordered], min_words)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _got(df, **options):
    found = sub.without_repeats(df, keep=["doc_id"], new_text=False, **options)
    return sorted(((r.doc_id, r["__n_words"], r["__n_removed"], r["__kept_sha256"]) for r in found.collect()), key=str)


def _corpus(r, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß\x1c", "x" * 300]
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(3, 40))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randrange(0, 8)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(1, 25))]
        if texts and r.random() < 0.2:
            words = _words(r.choice(texts))
            if words and r.random() < 0.6:
                words[r.randrange(len(words))] = "edit"
        texts.append(r.choice([" ", "\n", " \t "]).join(words))
    return texts


def test_hashes_follow_the_words():
    texts = [b"  one two\x0bthree ", b"", b"\n", b"two one", "é one".encode()]
    hashes, counts = sub.word_hashes(texts)
    assert counts.tolist() == [3, 0, 0, 2, 2]
    assert hashes[0] == hashes[4] == hashes[6] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    assert sub.word_hashes([])[0].tolist() == []


@pytest.mark.parametrize("min_words, seed, heavy", [(20, 8, 1.0), (6, 3, 1.0), (6, 6, 1.0), (5, 2, 0.0), (1, 1, 1.0)])
def test_equals_brute_force(spark, monkeypatch, min_words, seed, heavy):
    monkeypatch.setattr(sub, "HEAVY", heavy)
    r = random.Random(min_words * 100 + seed)
    rows = [(i * 3 - 40, t) for i, t in enumerate(_corpus(r, 120))] + [(2000, None), (2001, "")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, doc int, ranges string").repartition(5)
    assert _got(df, min_words=min_words, seed=seed) == sorted(_want(rows, min_words), key=str)


def test_heavy_anchors_take_the_other_way(spark, monkeypatch):
    r = random.Random(9)
    phrase = " ".join(f"p{i}" for i in range(9))
    rows = [(i, " ".join(f"{phrase} n{r.randrange(5 if i % 2 else 10**9)}" for _ in range(6))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(sub._heavy_anchors(sub.keyed(df), 20, 8)) > 0
    assert _got(df) == sorted(_want(rows, 20), key=str)
    monkeypatch.setattr(sub, "FLUSH_BYTES", 100)
    assert _got(df) == sorted(_want(rows, 20), key=str)


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (4, text + " x"), (4, text + " y"), (7, "k " + text), (7, "k " + text), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sub.without_repeats(df).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 6 and by[(None, text)]["__n_removed"] == 30 and by[(7, "k " + text)]["__n_removed"] == 30
    assert sorted(by[(4, t)]["__n_removed"] for t in (text + " x", text + " y")) == [0, 30]
    r = by[(7, "k " + text)]
    assert bytes(r["__kept"]) == b"k " and [tuple(x) for x in r["__spans"]] == [(1, 30)]
    assert sub.without_repeats(df.filter(F.lit(False))).count() == 0


def test_stage_keeps_other_words(spark):
    text = " ".join(f"a{i}" for i in range(25))
    rows = [(1, "start\n" + text, "s", 1), (2, "  other\t" + text + "  end\n", None, 2), (3, " as it was ", "s", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in sub.stage(spark, docs, "").collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[3].n_chars == 99
    assert got[2].text == "  other\tend\n" and got[2].n_chars == 12


def test_bad_parameters(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        sub.without_repeats(df, seed=21)


def test_span_hash_is_position_free():
    r = np.random.default_rng(1)
    words = r.integers(0, 2**63, 40).astype(np.uint64)
    a, _ = sub.anchors(words, np.array([40]), 20, 8)
    b, doc = sub.anchors(np.concatenate([r.integers(0, 2**63, 33).astype(np.uint64), words]), np.array([33, 40]), 20, 8)
    b = b[doc == 1]
    assert (a == b).all()
