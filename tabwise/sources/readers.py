"""Table, parameter, cache and model readers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .paths import active_session, path_exists, read_text

_FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


# CSV dialect of readers and writers: quotes are doubled inside quoted text. An
# empty field is missing; quoted emptiness ("") is the empty string. The null
# marker on read only keeps the two apart; no text field may consist of it.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"'}
CSV_READ_NULL = "\u0001"


def quoted(name: str):
    """A column by its exact name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes SQL NULL so that every operator sees one 'missing'."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(quoted(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read by suffix. CSV gets a header; types are inferred unless a schema is given.

    ``multi_line`` allows line breaks inside quoted CSV text; such files cannot
    be split, so it is off unless asked for.
    """
    path_l = path.rstrip("/").lower()
    fmt = next((v for k, v in _FORMATS.items() if path_l.endswith(k)), None)
    if fmt is None:
        raise ValueError(f"unsupported file type: {path!r}; use .csv, .json or .parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.options(**CSV_DIALECT, nullValue=CSV_READ_NULL, inferSchema=schema is None, multiLine=multi_line).csv(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return nan_to_null(df)


CORRUPT = "_corrupt_record"


@dataclass
class Checked:
    """Rows that fit the schema, and the records that do not: (file, record, reason)."""
    rows: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """Rejected records of each file and reason."""
        return self.rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))

    def require_clean(self) -> DataFrame:
        """The rows, if no record was rejected; else an error that shows one."""
        bad = self.rejects.first()
        if bad is not None:
            raise ValueError(f"{bad.file}: {bad.reason}: {bad.record!r}")
        return self.rows


def read_checked(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, multi_line: bool = False) -> Checked:
    """S1 with rejects: CSV or JSON lines under a stated schema, parsed once.

    A record is rejected whole if it cannot be parsed, has another number of fields (CSV), or holds a value that
    is none of its column's type. The reason is ``fields`` or the first such column; for JSON it is ``record``. An
    empty CSV field and a missing JSON field are missing values. The parsed records are written once (lineage cut): rows and
    rejects are two views of that copy.
    """
    kind = next((v for k, v in _FORMATS.items() if path.rstrip("/").lower().endswith(k)), None)
    if kind not in ("csv", "json"):
        raise ValueError(f"{path!r}: rejects are told from .csv and .json files")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]
    if CORRUPT in names:
        raise ValueError(f"{CORRUPT} is the name of the rejected record")
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line)
    parsed = reader.options(**{**CSV_DIALECT, "header": header}, nullValue=CSV_READ_NULL).csv(path) if kind == "csv" else reader.json(path)
    parsed = cut_lineage(parsed.withColumn("_file", F.input_file_name()))
    rows = nan_to_null(parsed.where(F.col(CORRUPT).isNull()).select(*[quoted(n) for n in names]))
    reason = F.lit("record")
    if kind == "csv":
        # The record again, as texts: how many fields it has, and which of them is no value of its column.
        options = {"quote": CSV_DIALECT["quote"], "escape": CSV_DIALECT["escape"], "nullValue": CSV_READ_NULL}
        texts = F.from_csv(CORRUPT, ", ".join(f"f{i} STRING" for i in range(len(names) + 1)), options)
        field = lambda i: texts.getField(f"f{i}")
        wrong = F.coalesce(*[F.when(field(i).isNotNull() & (field(i) != "") & quoted(n).isNull(), F.lit(n)) for i, n in enumerate(names)], F.lit("record"))
        reason = F.when(field(len(names) - 1).isNull() | field(len(names)).isNotNull(), F.lit("fields")).otherwise(wrong)
    rejects = parsed.where(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"), reason.alias("reason"))
    return Checked(rows, rejects)


def load_split(spark: SparkSession, path: str, split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """A dataset stored once, partitioned by ``split`` ('train' / 'test')."""
    df = nan_to_null(spark.read.parquet(path))
    return (df.where(F.col(split_col) == "train").drop(split_col),
            df.where(F.col(split_col) == "test").drop(split_col))


def load_params(path: str | None, required: bool = False, allow_missing: bool = True) -> dict:
    """S3: hyperparameters from a JSON object at any path Spark can read.

    No path gives {} unless ``required``. A path that does not exist gives {}
    only with ``allow_missing`` (and not ``required``).
    """
    if not path:
        if required:
            raise FileNotFoundError(path)
        return {}
    spark = active_session()
    if not path_exists(spark, path):
        if required or not allow_missing:
            raise FileNotFoundError(path)
        return {}
    return json.loads(read_text(spark, path))


CACHE_SCHEMA = "lat_key DOUBLE, lon_key DOUBLE, location STRING"


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE_SCHEMA)


def one_per_key(cache: DataFrame) -> DataFrame:
    """The cache with one row per key (ties: smallest name), whatever was appended to it."""
    return cache.groupBy("lat_key", "lon_key").agg(F.min("location").alias("location"))


def load_cache(spark: SparkSession, path: str | None, allow_missing: bool = False) -> DataFrame:
    """The location cache table. No path, or a missing one with ``allow_missing``, is an empty cache."""
    if not path:
        return empty_cache(spark)
    if not path_exists(spark, path):
        if not allow_missing:
            raise FileNotFoundError(path)
        return empty_cache(spark)
    return spark.read.parquet(path).select("lat_key", "lon_key", "location")


def import_json_cache(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """S4 importer for the old JSON cache: one JSON object ``{"(lat, lon)": name, ...}`` per row.

    Keys are parsed with a regular expression, never evaluated. Keys that are not
    two finite numbers are left out; a key that occurs several times keeps its
    smallest name.
    """
    kv = raw.select(F.explode(F.from_json(F.col(text_col), "map<string,string>")).alias("k", "location"))
    num = r"\s*(-?[0-9.eE+-]+)\s*"
    pat = r"^\(" + num + "," + num + r"\)$"
    parsed = kv.select(
        F.regexp_extract("k", pat, 1).try_cast("double").alias("lat_key"),
        F.regexp_extract("k", pat, 2).try_cast("double").alias("lon_key"),
        "location",
    )
    return one_per_key(parsed.where("lat_key IS NOT NULL AND lon_key IS NOT NULL"))


def load_model(path_or_model):
    """A fitted PipelineModel, either given or read from a path."""
    if isinstance(path_or_model, str):
        from pyspark.ml import PipelineModel
        return PipelineModel.load(path_or_model)
    return path_or_model
