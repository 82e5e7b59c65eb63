import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabwise.llm import simhash_dedup as sd


def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(prints, max_bits):
    n, label = len(prints), list(range(len(prints)))
    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_fingerprint_equals_definition_and_spark(spark, monkeypatch):
    monkeypatch.setattr(sd, "_CHUNK", 5)
    texts = ["", " ", "One", "one TWO", "a b c", "A b C d e É é", "x y z " * 50, "ÀÉ ß\x0bw\x1cq  r\n\nt"]
    for t in texts:
        assert sd.fingerprint(t.encode()) == _print(t)
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert sd.fingerprint(b"A b c") == got % 2**64


def _points(r, n):
    base = [r.getrandbits(64) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        p = r.choice(out)
        for _ in range(r.randrange(0, 4)):
            p ^= 1 << r.randrange(64)
        out.append(p)
    return out


def test_local_tree_equals_brute_force(monkeypatch):
    monkeypatch.setattr(sd, "LEAF", 4)
    r = random.Random(5)
    for bits in (0, 2, 3):
        points = np.array(sorted(set(_points(r, 300))), np.uint64)
        assert sd.linked(points, np.ones(len(points), bool), bits).tolist() == _roots([int(p) for p in points], bits)


def test_shards_keep_every_pair():
    r = random.Random(6)
    points = np.array(sorted(set(_points(r, 400))), np.uint64)
    tree = sd.shard_tree(points[:100], 4)
    row, shard, home = sd.shards_of(tree, points, 2)
    assert sorted(row[home].tolist()) == list(range(len(points)))
    found = set()
    for s in set(shard.tolist()):
        at, mine = row[shard == s], home[shard == s]
        for i in range(len(at)):
            for j in np.flatnonzero(mine):
                if at[i] != at[j] and bin(int(points[at[i]]) ^ int(points[at[j]])).count("1") <= 2:
                    found.add(frozenset((int(at[i]), int(at[j]))))
    want = {frozenset((i, j)) for i in range(len(points)) for j in range(i) if bin(int(points[i]) ^ int(points[j])).count("1") <= 2}
    assert found == want and want


def _components(rows, prints, max_bits=2):
    distinct = sorted(set(prints))
    label = dict(zip(distinct, _roots(distinct, max_bits)))
    least = {}
    for (doc_id, *_), p in zip(rows, prints):
        if doc_id is not None:
            least[label[p]] = min(least.get(label[p], doc_id), doc_id)
    return [(doc_id, least.get(label[p])) for (doc_id, *_), p in zip(rows, prints)]


def test_operator_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "LEAF", 8)
    r = random.Random(7)
    prints = _points(r, 500) + [0] * 40
    rows = [(None if i % 50 == 7 else 1000 - i,) for i in range(len(prints))]
    data = [(d, int(np.uint64(p).astype(np.int64)), 5, 6) for (d,), p in zip(rows, prints)]
    docs = spark.createDataFrame(data, "doc_id long, __fp long, component_id int, root int").repartition(3)
    got = sd.near_duplicates(docs, sample=400, shard_points=40).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == sorted(_components(rows, prints), key=str)
    assert sd.near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [_print(t) for _, t in docs]
    want = [(d, f"{p:016x}", c) for p, (d, c) in zip(prints, _components(docs, prints))]
    got = sd.op6_simhash_dedup(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({c for *_, c in want}) < len(want)


def test_stage_keeps_one_of_each_group(spark):
    text = "some words that are long enough to be told apart from others in this test"
    rows = [(5, text, "en"), (3, text.upper(), "x"), (3, text, "en"), (9, "quite another text with its own words in it", None), (None, "no id here at all today", "q"),
            (None, "no id here at all today", "q"), (7, None, "e"), (8, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sd.stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert len(kept) == 4 and {k[0] for k in kept} == {3, 9, None, 7}


def test_stage_keeps_one_of_a_group_without_ids(spark, monkeypatch):
    prints = {"a": 0, "b": 1, "c": 3, "d": 7 << 40, "e": 7 << 40, "f": 15 << 20}
    monkeypatch.setattr(sd, "with_fingerprints", lambda docs: docs.withColumn("__fp", F.create_map(
        *[x for k, v in prints.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("text")]))
    docs = spark.createDataFrame([(None, "c"), (None, "a"), (None, "b"), (5, "d"), (None, "e"), (5, "f"), (None, "b")], "doc_id long, text string")
    got = sorted((r.text, r.doc_id) for r in sd.stage(spark, docs, "").collect())
    assert got == [("a", None), ("d", 5), ("f", 5)]


def test_sample_grows_with_the_shards_wanted(spark, monkeypatch):
    r, seen, tree = random.Random(3), [], sd.shard_tree
    monkeypatch.setattr(sd, "shard_tree", lambda points, depth: seen.append((len(points), depth)) or tree(points, depth))
    monkeypatch.setattr(sd, "star_components", lambda edges: edges)
    prints = spark.createDataFrame([(r.getrandbits(63),) for _ in range(1000)], "fp long")
    sd.near_components(prints, sample=64, shard_points=40)
    assert seen == [(512, 5)]
