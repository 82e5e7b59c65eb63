"""Token-ID output: Parquet list columns, in ascending document order.

``write_tokens`` sorts the documents by id (range partitions), encodes each
partition in its task and writes it as one Parquet file in the shared folder:
ids as a dictionary- or delta-encoded list column, metadata columns beside it,
row groups of a stated number of tokens, small data pages and a page index. A
reader that asks for a few documents opens the files whose first and last id, in the manifest,
lie around them, and there the row groups and pages it needs; one that asks for metadata
reads only its columns.

A file is written under the name of its task's attempt; the manifest, itself a
table in the shared folder, names the files of the attempts that succeeded. A
task that is run again leaves a file that no manifest names. Tokens before a
file are the running sum of the manifest's counts (one row for each file).

Defined results: null text is empty; a document without words holds the end id
only. Null ids sort first. Rows with equal ids are ordered by the text's hash,
repeated rows by their place in the input, which spreads them over files. An empty table gives no file and no
row. Other columns are not written, but for those named in ``keep``; a name that the files use
themselves is an error there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.llm.common import filesystem, materialize, offsets, shared_path, steps, table, text_bytes
from tabwise.llm.tokens import TOKENIZER, encoder, tokenizer_file, with_end

#: Tokens of a row group at least (the last of a file may be smaller), bytes of a data page.
GROUP_TOKENS, PAGE_BYTES = 1 << 20, 64 << 10
END_ID = 2
RESERVED = ("doc_id", "file_start", "start", "n_tokens", "tokens", "tokens.list.element", "file", "tokens_before", "__text", "__hash", "__row")


def _writer(folder: str, path: str, end_id: int, keep: list[str], group_tokens: int, page_bytes: int, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
        encode, writer, groups, held, rows, total, first, last = encoder(path).encode, None, [], 0, 0, 0, None, None
        fs, where = filesystem(folder)
        options = ({"use_dictionary": ["tokens.list.element", *keep]} if encoding == "dictionary" else
                   {"use_dictionary": keep or False, "column_encoding": {"tokens.list.element": "DELTA_BINARY_PACKED"}})
        try:
            for batch in steps(batches, "__text"):
                ids, counts = with_end(*encode(batch.column("__text").to_pylist()), end_id)
                at = offsets(counts)
                group = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(total + at[:-1]), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4"))), *(batch.column(c) for c in keep)],
                    names=["doc_id", "file_start", "n_tokens", "tokens", *keep])
                groups.append(group)
                first = batch.column("doc_id")[0].as_py() if not rows else first  # null ids sort first: they have a file's start
                last = batch.column("doc_id")[-1].as_py()
                held, rows, total = held + len(ids), rows + batch.num_rows, total + len(ids)
                if held >= group_tokens:
                    writer = writer or _open(fs, f"{where}/{name}", group.schema, page_bytes, options)
                    writer.write_table(pa.Table.from_batches(groups), row_group_size=1 << 30)
                    groups, held = [], 0
            if groups:
                writer = writer or _open(fs, f"{where}/{name}", groups[0].schema, page_bytes, options)
                writer.write_table(pa.Table.from_batches(groups), row_group_size=1 << 30)
        finally:
            if writer:
                writer.close()
        if rows:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_rows": [rows], "file_tokens": [total], "first_id": [first], "last_id": [last]},
                                             schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("file_tokens", pa.int64()),
                                                               ("first_id", pa.int64()), ("last_id", pa.int64())]))
    return run


def _open(fs, path: str, schema: pa.Schema, page_bytes: int, options: dict) -> pq.ParquetWriter:
    return pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd", data_page_size=page_bytes, write_page_index=True,
                            write_statistics=["doc_id", "file_start", "n_tokens"], **options)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
                 keep: tuple[str, ...] = (), group_tokens: int = GROUP_TOKENS, page_bytes: int = PAGE_BYTES,
                 encoding: str = "dictionary") -> DataFrame:
    """Write the token files below ``folder``; returns the manifest: part, file, n_rows, file_tokens, first_id, last_id, tokens_before."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    if clash := {*RESERVED} & {c.lower() for c in keep}:
        raise ValueError(f"the files have columns of their own named {sorted(clash)}")
    spark = docs.sparkSession
    _make(folder)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`")).alias("__text"), *[F.col(f"`{c}`") for c in keep])
    order = ["doc_id", "__hash", "__row"]
    source = source.withColumns({"__hash": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    source = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__row")
    run = _writer(folder, tokenizer_file(tokenizer), end_id, list(keep), group_tokens, page_bytes, encoding)
    written = materialize(source.mapInArrow(run, "part int, file string, n_rows long, file_tokens long, first_id long, last_id long"), "token-files")
    before = F.coalesce(F.sum("file_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = written.withColumn("tokens_before", before)  # one row a file
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _make(folder: str) -> None:
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)


def read_tokens(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens"),
                doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Documents of a token folder, only the named columns, optionally only ids from doc_ids[0] to doc_ids[1]."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    schema = "doc_id long, file_start long, n_tokens long, tokens array<int>"
    extra = [c for c in columns if c not in ("doc_id", "start", "n_tokens", "tokens")]
    reader = spark.read.option("pathGlobFilter", "part-*.parquet")
    where = [folder]
    if doc_ids is not None:
        near = manifest.filter((F.col("last_id") >= doc_ids[0]) & (F.coalesce(F.col("first_id"), F.lit(doc_ids[0])) <= doc_ids[1]))
        where = [f"{folder}/{r.file}" for r in near.select("file").collect()] or where  # no file: the filter below leaves nothing
    found = (reader.parquet(*where) if extra else reader.schema(schema).parquet(*where)).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    if doc_ids is not None:
        found = found.filter(F.col("doc_id").between(*doc_ids))
    found = found.join(manifest.select("file", "tokens_before"), "file")  # also leaves out files of failed attempts
    return found.withColumn("start", F.col("tokens_before") + F.col("file_start")).select(*columns)


def digest_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids (little-endian unsigned 32-bit), from rows of ``read_tokens``."""
    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4").view(np.uint8).data
            at = 4 * offsets(np.diff(np.asarray(lists.offsets)))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return documents.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and describe what is read back."""
    folder = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return digest_tokens(read_tokens(spark, folder))
