"""Corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing, best-fit packing.

Each stage takes the documents its predecessor kept and returns documents; the
last returns the packed pieces. ``run`` writes every stage as a Parquet table in
the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwise.llm import packing, quality_rules, simhash_dedup, source_mixing, substring_dedup
from tabwise.llm.common import materialize, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("source_mixing", source_mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: Tokenizer ids and component search cannot be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
