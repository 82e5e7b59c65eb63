"""Flagship plan: the reference's preprocessing order on supplier data.

count sources (F1) -> locate through the cache (J1) -> ordinal-encode the
location and the account segment (T1/T2, fitted on train) -> stratified split
(R1) -> class balance per split (A5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, encode, locate, split
from . import fixtures as fx


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = fx.table(spark, sf_dir, "supplier"), fx.table(spark, sf_dir, "nation")
    base = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        "s_suppkey",
        F.concat_ws(", ", F.concat(F.lit("nat"), F.col("s_nationkey").cast("string")),
                    F.concat(F.lit("reg"), F.col("n_regionkey").cast("string")),
                    F.when(F.col("s_suppkey") % 2 == 0, F.lit("even"))).alias("sources"),
        (F.col("s_acctbal") / 130.0).alias("latitude"),
        (F.col("s_nationkey").cast("double") * 1.5).alias("longitude"),
        F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "low").otherwise("high").alias("segment"),
        (F.col("n_regionkey") % 2).alias("label"),
    )
    counted = clean.count_sources(base, "sources")
    located = locate.enrich_location(counted, fx.location_cache(spark, sf_dir))
    parts = split.stratified_split(located, "label", ["s_suppkey"], 0.2, 42)
    train = parts.where(F.col("split") == "train")
    mapping = encode.fit_ordinal(train, ["location", "segment"])
    encoded = encode.transform_ordinal(parts, mapping, ["location", "segment"])
    return (encoded.groupBy("split", "label")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("source_counter").alias("sources"),
                 F.countDistinct("location").alias("n_locations")))
