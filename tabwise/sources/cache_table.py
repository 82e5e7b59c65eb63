"""The location cache as a bucketed table.

Entries are stored in files by the hash of their coordinate key, sorted inside. The key is stored as whole ten-thousandths of a degree: the planner
does not take buckets of floating numbers for their groups, as zeros and NaN have several forms. A lookup
therefore shuffles only the rows that ask; the cache's side of the join, and the reduction to one row a key, read
the buckets as they are (no exchange in the plan). An append writes only the keys that the table does not hold
yet, as new files of the same buckets; the table is never rewritten.

Appends are idempotent: a batch has an id, and a finished batch leaves a marker. A batch that is repeated after its marker writes nothing, one that
died before it finds its keys in the table and writes none twice. Two appends at the same time may both write a key; readers reduce
keys to one row (smallest name), so every lookup sees one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import path_exists, read_hidden_text, write_text

#: The rounded coordinates as whole numbers (four decimals, as in ``geo_key``).
KEYS = ["lat_e4", "lon_e4"]
#: Buckets of a new table: at least the shuffle partitions of the jobs that look up, so that the planner keeps them.
BUCKETS = 256


def whole_keys(df: DataFrame, lat_key: str = "lat_key", lon_key: str = "lon_key") -> DataFrame:
    """``df`` with the whole-number key of its rounded coordinates; null if either is missing."""
    return df.withColumns({k: F.round(F.col(c) * 10_000).cast("long") for k, c in zip(KEYS, (lat_key, lon_key))})


class CacheTable:
    """Cache of locations below ``path``; made on first use, opened by its path afterwards."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/_table.json"
        if path_exists(spark, about):
            buckets = json.loads(read_hidden_text(spark, about))["buckets"]
        else:
            write_text(spark, about, json.dumps({"buckets": buckets}))
        self.buckets = buckets
        self.name = "cache_" + hashlib.md5(self.path.encode()).hexdigest()
        where = self.path.replace("'", "\\'")
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name} (lat_e4 BIGINT, lon_e4 BIGINT, location STRING, batch STRING) USING PARQUET
                      CLUSTERED BY (lat_e4, lon_e4) SORTED BY (lat_e4, lon_e4) INTO {int(buckets)} BUCKETS LOCATION '{where}'""")

    def entries(self) -> DataFrame:
        """Every stored entry with the batch that wrote it."""
        return self.spark.table(self.name)

    def keyed(self) -> DataFrame:
        """(lat_e4, lon_e4, location): one row a key, in the table's buckets."""
        return self.entries().groupBy(*KEYS).agg(F.min("location").alias("location"))

    def read(self) -> DataFrame:
        """(lat_key, lon_key, location): one row a key, as the other cache readers give it."""
        return self.keyed().select(*[(F.col(k) / 10_000.0).alias(c) for k, c in zip(KEYS, ("lat_key", "lon_key"))], "location")

    def _marker(self, batch: str) -> str:
        return f"{self.path}/_batches/{hashlib.md5(batch.encode()).hexdigest()}"

    def append(self, new_entries: DataFrame, batch: str) -> bool:
        """Write the keys of ``new_entries`` that the table does not hold; False if the batch is there already.

        Entries without both coordinates are left out; a key that occurs several times keeps its smallest name.
        """
        if path_exists(self.spark, self._marker(batch)):
            return False
        known = whole_keys(new_entries).where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
        new = known.groupBy(*KEYS).agg(F.min("location").alias("location")).join(self.entries().select(*KEYS), KEYS, "left_anti")
        new.repartition(self.buckets, *KEYS).select(*KEYS, "location", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        write_text(self.spark, self._marker(batch), batch)
        return True

    def forget(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
