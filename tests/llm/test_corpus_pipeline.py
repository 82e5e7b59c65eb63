"""The pipeline against the operators' brute-force definitions, stage by stage."""

import random
import re

from pyspark.sql import functions as F
from test_mixing import _brute as mixed
from test_quality import _brute as judged
from test_simhash import _components, _print
from test_substring import _brute as repeated
from tokenizers import Tokenizer

import corpus_pipeline
from tabwise.llm import quality_rules, source_mixing
from tabwise.llm.tokens import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(r):
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(60, 400)))
        if i % 7 == 0:
            text += "\n" + shared
        rows.append([i, text, "en", "big" if i % 3 else f"s{i % 4}", len(text)])
    rows += [[100, rows[3][1], "en", "big", 1], [101, rows[4][1].replace("w1", "W1"), None, None, 1], [102, "too short", "en", "s0", 9], [103, "again and again " * 60, "en", "s1", 1],
             [104, None, "en", "s2", None], [105, "", "fr", "s3", 0]]
    return [tuple(x) for x in rows]


def test_names_and_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = _documents(random.Random(11))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if judged(r[1], quality_rules.MIN_REPEAT, quality_rules.MAX_COVERED, quality_rules.MAX_LONGEST)[-1]]
    assert len(kept) < len(rows)
    kept.sort()
    groups = _components(kept, [_print(r[1]) for r in kept])
    kept = [r for r, (doc_id, first) in zip(kept, groups) if doc_id == first]
    assert 100 not in {r[0] for r in kept} and 101 not in {r[0] for r in kept}
    texts = []
    for r, (words, gone) in zip(kept, repeated([r[1] for r in kept], 20)):
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1])] + [len(r[1])]
        texts.append(r[1] if not any(gone) else "".join(r[1][a:b] for a, b, g in zip([0, *starts[1:-1]], starts[1:], gone) if not g))
    assert any(t != r[1] for t, r in zip(texts, kept))
    text_of = dict(zip((r[0] for r in kept), texts))
    copies = mixed([(r[0], text_of[r[0]], r[3]) for r in kept], target_entropy=source_mixing.TARGET_ENTROPY)
    whole = Tokenizer.from_file(tokenizer_file())
    want = []
    for doc_id, *_ in copies:
        n = len(whole.encode(text_of[doc_id], add_special_tokens=False).ids) + 1
        want += [(doc_id, k // 2048, k, min(2048, n - k)) for k in range(0, n, 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == sorted(want) and len(copies) > len(kept)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 for x in used.values())


def test_stages_on_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema) if "piece" in out.columns else out


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.createDataFrame(_documents(random.Random(2))[:30], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.filter(F.col("text").isNull()).count() == 0
        docs = out


def test_stages_keep_the_values_of_columns_named_like_results(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{text} {i}", "ab"[i % 2], -i, f"k{i}", i / 4, -7 - i, f"t{i}") for i in range(20)],
                                 "doc_id long, text string, source string, n_words long, Kept string, place double, epoch int, n_tokens string")
    want = sorted(map(tuple, docs.collect()))
    for stage in (quality_rules.stage, source_mixing.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert sorted(set(map(tuple, out.collect()))) == want


def test_mixing_stage_writes_rows_by_place(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text of {i} " * 30, "big" if i % 5 else "small") for i in range(300)], "doc_id long, text string, source string").repartition(3)
    want = [r.doc_id for r in source_mixing.mix(docs).orderBy("place").collect()]
    source_mixing.stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    files = sorted(tmp_path.glob("mixed/part-*"))
    assert [i for f in files for i in spark.read.parquet(str(f)).toPandas()["doc_id"]] == want and len(want) > 300


CLASHES = ("__text", "__fp", "__doc", "__sub", "__n", "__key", "__root", "a.b", "n_words", "kept", "n_tokens", "epoch", "place", "component_id", "__own0", "__source", "doc")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(60)) + (" " + " ".join(f"s{k}" for k in range(30)) if i % 2 else ""), "big", None, *(f"{c} of {i}" for c in CLASHES)) for i in range(6)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted({r.doc_id for r in got}) == list(range(6)), name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in got for c in CLASHES), name


def test_packing_keeps_columns_of_any_name(spark):
    from tabwise.llm.packing import pack

    names = ["__shard", "__l", "__n", "__size", "__p0", "a.b", "length.of", "__rows"]
    pieces = spark.createDataFrame([(*(f"{n}{i}" for n in names), 600 + i, -1) for i in range(9)], ", ".join(f"`{n}` string" for n in names) + ", length long, offset long")
    out = pack(pieces, order=("a.b", "length"))
    assert out.columns == [*names, "length", "sequence_id", "offset"]
    rows = out.collect()
    assert sorted(r["a.b"] for r in rows) == [f"a.b{i}" for i in range(9)] and len({r.sequence_id for r in rows}) == 3 and all(r.offset >= 0 for r in rows)
