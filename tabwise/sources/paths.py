"""Small files and path checks through Spark's file system, so that any URI the
session can read (``file:``, ``hdfs:``, object stores) works, not only local paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _file_system(spark, path)
    fs.delete(jpath, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small configuration file, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_hidden_text(spark: SparkSession, path: str) -> str:
    """A small file, whole, of a name that Spark's readers pass over (a leading underscore)."""
    fs, jpath = _file_system(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small configuration file as one file at exactly ``path``."""
    fs, jpath = _file_system(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark
