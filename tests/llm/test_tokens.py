import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwise.llm import token_binary, tokens
from tabwise.llm.common import shared_path
from tabwise.llm.tokens import Encoder, tokenizer_file

ODD = ["", " ", "Hello, World!", "it's we'll can't 'Tis ''quoted'' rock'n'roll", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext |>",
       "é é é ñ İstanbul STRASSE ß ẞ Σίσυφος ΟΔΥΣΣΕΥΣ", "x\x1cy \x1c! !\x1f! a\x85b a\xa0b c d", "日本語 テキスト 12345 3.14 1e10", "naïve—dash… “q”",
       "́ combining ́a", "a\tb\nc\rd\x0be\x0cf", "|<>| <| |> ||", "🙂🙂 👩‍👩‍👧", "a.b.c,d;e 'sx 's 't're", "ｆｕｌｌ ﬁ ǅ ª º µ", "0 00 12 ٣", "x" * 5000, ". , ." * 50]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_file())


def test_chunks_equal_whole_texts(whole):
    encode = Encoder(tokenizer_file()).encode
    for texts in ([], ODD, ODD * 2):
        ids, counts = encode([t.encode() for t in texts])
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_every_latin1_pair(whole):
    chars = [chr(c) for c in [*range(1, 256), 0x17F, 0x130, 0x131, 0x301, 0x2019]]
    texts = [a + b for a in chars for b in "aZ'.é0 "] + ["s" + a + "t." for a in chars]
    ids, counts = Encoder(tokenizer_file(), cache_chunks=100).encode([t.encode() for t in texts])
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_cache_starts_anew(whole):
    e = Encoder(tokenizer_file(), cache_chunks=3)
    for _ in range(3):
        for t in ODD:
            assert e.encode([t.encode()])[0].tolist() == whole.encode(t, add_special_tokens=False).ids


def _brute(rows, whole):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, whole, encoding):
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, tokens int").repartition(5)
    folder = shared_path(spark, "t")
    manifest = token_binary.write_tokens(docs, folder, group_tokens=50, encoding=encoding)
    got = token_binary.digest_tokens(token_binary.read_tokens(spark, folder)).collect()
    want = _brute(sorted(rows, key=lambda r: (r[0] is not None, r[0])), whole)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    some = token_binary.read_tokens(spark, folder, ("doc_id", "n_tokens"), (90, 95))
    assert sorted(r.doc_id for r in some.collect()) == list(range(90, 96))
    file = f"{folder.removeprefix('file:')}/{manifest.filter('n_rows > 1').first().file}"
    meta = pq.ParquetFile(file).metadata
    names = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert names["doc_id"].has_offset_index and any(("DICTIONARY" if encoding == "dictionary" else "DELTA") in e for e in names["tokens.list.element"].encodings)


def test_repeated_rows_and_empty(spark, whole):
    docs = spark.createDataFrame([(1, "same text")] * 6 + [(1, "other")], "doc_id long, text string")
    folder = shared_path(spark, "t")
    token_binary.write_tokens(docs, folder)
    got = token_binary.read_tokens(spark, folder).orderBy("start").collect()
    assert len(got) == 7 and [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    folder = shared_path(spark, "t")
    token_binary.write_tokens(docs.filter(F.lit(False)), folder)
    assert token_binary.read_tokens(spark, folder).count() == 0


def test_registered_query(spark, whole):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_binary.op1_token_binary(spark, sf).collect())
    assert got == _brute(rows, whole)


def test_new_chunks_are_cut_at_once(whole):
    chunks = ["Word", "(Straße),", "ÀÖØÞßàöøÿ!", "a×b", "÷", "it's", "'tis", "x'", "...", "a1", "<|x", "x<|", "<x|", "日本", "é", "..É..", "́a", "Z" * 300]
    simple, sizes, lower = tokens._parts([c.encode() for c in chunks])
    assert [c for c, s in zip(chunks, simple) if s] == ["Word", "(Straße),", "ÀÖØÞßàöøÿ!", "x'", "<x|", "é", "..É..", "Z" * 300]
    assert sizes.tolist() == [[0, 4, 0], [1, 7, 2], [0, 18, 1], [0, 1, 1], [1, 1, 1], [0, 2, 0], [2, 2, 2], [0, 300, 0]]
    assert lower.tobytes().decode() == "word(straße),àöøþßàöøÿ!x'<x|é..é.." + "z" * 300
    ids, counts = Encoder(tokenizer_file())._chunks([c.encode() for c in chunks])
    want = [whole.encode(c, add_special_tokens=False).ids for c in chunks]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    words = pa.array([b"a", "é".encode(), b"bcd"], pa.binary())
    assert tokens._listed(words) == words.to_pylist() and tokens._listed(words[1:]) == words[1:].to_pylist() and tokens._listed(words[:0]) == []
