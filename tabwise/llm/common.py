"""Helpers shared by the operators of this package.

Words are ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` without arguments splits
UTF-8 text at exactly these six ASCII characters, so tasks work on bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.session import checkpoint_dir

#: Bytes of text that one step of a task works on at once (a single longer text is a step of its own).
STEP_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)


def text_bytes(col):
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.encode(col, "utf-8"), F.lit(b""))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, used) -> tuple[DataFrame, list]:
    """``docs`` with all columns but those of the names ``used`` renamed, and the columns that give ``docs`` back from an outcome.

    Whatever the other columns are called (an operator's results or helpers, names with dots), they meet no other name.
    """
    names = [c if c in used else f"__own{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def filesystem(uri: str):
    """pyarrow file system and path of a shared folder's URI, for tasks that write or range-read files."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (binary) holds at most ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = lengths(batch.column(column))
        at = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def lengths(array: pa.Array) -> np.ndarray:
    """Byte lengths of a binary array; null counts 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(counts) -> np.ndarray:
    """0 and the running sums of ``counts``."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
