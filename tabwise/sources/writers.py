"""Sinks (K1-K8). Data is always written by executors; only configuration
(parameter dicts) is written from the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import active_session, path_exists, write_text
from .readers import CSV_DIALECT, nan_to_null, one_per_key


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: format chosen by suffix; the path is a directory of part files. NaN is written as missing."""
    p = path.rstrip("/").lower()
    w = nan_to_null(df).write.mode(mode)
    if p.endswith(".csv"):
        w.options(**CSV_DIALECT, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue='""').csv(path)
    elif p.endswith(".json"):
        w.json(path)
    elif p.endswith(".parquet"):
        w.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {path!r}; use .csv, .json or .parquet")


def write_encoded(train: DataFrame, test: DataFrame | None, save_path: str, prefix: str = "encoder") -> None:
    """K2: encoded frames as ``{prefix}_X_train_encoded.csv`` / ``{prefix}_X_test_encoded.csv``."""
    write_table(train, f"{save_path}/{prefix}_X_train_encoded.csv")
    if test is not None:
        write_table(test, f"{save_path}/{prefix}_X_test_encoded.csv")


def write_mapping(mapping: DataFrame, save_path: str, prefix: str = "encoder") -> None:
    """K3: one encoder per column = one ``column_name=`` partition of the mapping table."""
    mapping.write.mode("overwrite").partitionBy("column_name").parquet(f"{save_path}/{prefix}_encoders.parquet")


def save_model(model, path: str) -> None:
    """K5: persist a fitted PipelineModel."""
    model.write().overwrite().save(path)


def save_params(params: dict, path: str = "best_params.json") -> None:
    """K6: best parameters (a small config dict) as JSON, at any path Spark can write."""
    write_text(active_session(), path, json.dumps(params))


def write_report(report: DataFrame, path: str) -> None:
    """K7: classification report table (E4) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_cache(new_entries: DataFrame, path: str) -> None:
    """K8: append the keys that the location cache table does not hold yet.

    Appending the same keys again changes nothing: entries are reduced to one
    row per key, keys without both coordinates are left out, and keys already in
    the table are anti-joined away.
    """
    spark = new_entries.sparkSession
    keys = ["lat_key", "lon_key"]
    new = one_per_key(new_entries.where("lat_key IS NOT NULL AND lon_key IS NOT NULL"))
    if path_exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)


def write_report_text(report: DataFrame, path: str) -> None:
    """K7 as text: 'Accuracy: %.4f', a blank line, then one aligned line per report row.

    The report has one row per class plus three summary rows (a bounded
    table); it is formatted by Spark and written as a single text file.
    """
    kind = (F.when(F.col("label") == "accuracy", 1)
            .when(F.col("label").isin("macro avg", "weighted avg"), 2).otherwise(0))
    acc = report.where(F.col("label") == "accuracy").select(
        F.lit(0).alias("_o"), F.lit("").alias("_l"), F.format_string("Accuracy: %.4f", F.col("f1")).alias("value"))
    header = report.sparkSession.createDataFrame(
        [(1, "", ""), (2, "", "Classification Report:"),
         (3, "", "%12s %9s %9s %9s %9s" % ("", "precision", "recall", "f1-score", "support"))],
        "_o INT, _l STRING, value STRING")
    body = report.select(
        (F.lit(4) + kind).alias("_o"), F.col("label").alias("_l"),
        F.when(kind == 1, F.format_string("%12s %9s %9s %9.2f %9d", F.col("label"), F.lit(""), F.lit(""),
                                          F.col("f1"), F.col("support")))
        .otherwise(F.format_string("%12s %9.2f %9.2f %9.2f %9d", F.col("label"), F.col("precision"),
                                   F.col("recall"), F.col("f1"), F.col("support"))).alias("value"))
    lines = acc.unionByName(header).unionByName(body).orderBy("_o", "_l").coalesce(1)
    lines.select("value").write.mode("overwrite").text(path)
