import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise.llm import quality_rules as qr


def _longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=4))
def test_repeats_equal_brute_force(docs):
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs]).astype(np.int64)
    got = qr.longest_repeats(doc, np.array(sum(docs, []), np.int64))
    assert got.tolist() == sum((_longest(d) for d in docs), [])


def _windows(words, k):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i:i + k]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)}
    return len(covered)


def _brute(text, min_repeat, max_covered, max_longest):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(words), _windows(words, 3)
    covered, longest = _windows(words, min_repeat), max(_longest(words), default=0)
    failed = n < 50 or 100 * repeat > 50 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, covered, longest, failed,
            not failed and covered <= max_covered * n and longest <= max_longest)


def test_operator_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "#x", "日本", "a\x1cb", "<p>"]
    texts = [None, "", " \n\t", "one", "\n\n a \n a \n", "x " * 300, "same line here\n" * 40, "a\r\nb\r\nb\r\n"]
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if len(words) > 20 and r.random() < 0.5:
            words += words[5:r.randrange(8, 20)]
        texts.append(r.choice([" ", "\n", "  \x0b"]).join(words))
    rows = [(i if i % 5 else None, t, 1, "k") for i, t in enumerate(texts)] + [(3, texts[9], 1, "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, other string").repartition(3)
    got = qr.apply_rules(df, min_repeat=4, max_covered=0.2, max_longest=10).collect()
    names = (*qr.COUNTS, "base_failed", "kept")
    assert sorted(((x.doc_id, x.text, x.other, *(x[c] for c in names)) for x in got), key=str) == sorted(
        ((i, t, "k", *_brute(t, 4, 0.2, 10)) for i, t, *_ in rows), key=str)
    assert any(x.kept for x in got) and any(not x.kept and not x.base_failed for x in got)
    assert qr.apply_rules(df.filter(F.lit(False))).count() == 0


def test_very_long_text_and_steps(spark, monkeypatch):
    text = " ".join(str(i * i % 100_003) for i in range(60_000)) + " tail" * 3
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in qr.apply_rules(df).collect()}
    assert got[1].n_words == 60_003 and got[1].longest_repeat == got[3].longest_repeat and got[2].base_failed
