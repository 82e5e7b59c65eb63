"""Cached location enrichment (J1-J4, P5-P7) as set-based joins.

The per-row dictionary probe becomes one equi-join on rounded coordinate
keys. The cache is a table that grows, so no broadcast hint is forced: the
planner (and AQE at runtime, from the measured size) broadcasts it while it
is small and falls back to a shuffle join when it is not. External lookups
are not made from executors; the caller supplies a *response table*
``(lat, lon, components MAP<STRING,STRING>)`` for keys it resolved elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import LOCATION_FIELDS, UNKNOWN_LOCATION, first_non_empty, geo_key
from ..session import cut_lineage
from ..sources.cache_table import CacheTable, whole_keys
from ..sources.readers import one_per_key
from .skew import left_join_on_keys

KEYS = ["lat_key", "lon_key"]
# Ids of a lookup budget up to this many are broadcast; a larger budget is joined by shuffle.
BROADCAST_IDS = 100_000


def with_geo_key(df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """add the rounded (lat_key, lon_key) pair."""
    return df.withColumn("lat_key", geo_key(lat_col)).withColumn("lon_key", geo_key(lon_col))


def _join_cache(keyed: DataFrame, cache: DataFrame, out_col: str) -> DataFrame:
    """``keyed`` (with the key pair) and the cache's name in ``out_col``, NULL for a miss or a missing coordinate.

    Rows without coordinates (often many) match nothing and stay out of the
    join, so they cannot meet in one task. Rows of a popular coordinate can; they are joined with the
    broadcast entries of the hot keys (see ``skew``), all others as the planner chooses. ``lookup_stored`` spares a large cache the shuffle.
    """
    known = F.col("lat_key").isNotNull() & F.col("lon_key").isNotNull()
    c = one_per_key(cache.select(*KEYS, "location")).withColumnRenamed("location", out_col)
    hits = left_join_on_keys(keyed.where(known), c, KEYS).select(*keyed.columns, out_col)
    rest = keyed.where(~known).withColumn(out_col, F.lit(None).cast("string"))
    return hits.unionByName(rest)


def lookup(df: DataFrame, cache: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude",
           out_col: str = "cached_location") -> DataFrame:
    """Left join to the cache on the rounded key; hit -> cached name, miss -> NULL."""
    found = _join_cache(with_geo_key(df, lat_col, lon_col), cache, out_col)
    return found.select(*KEYS, *[c for c in df.columns if c not in KEYS], out_col)


def lookup_stored(df: DataFrame, table: CacheTable, lat_col: str = "latitude", lon_col: str = "longitude",
                  out_col: str = "cached_location") -> DataFrame:
    """J1 on a bucketed cache table: as ``lookup``, but only the rows that ask are shuffled, to the table's buckets."""
    keyed = whole_keys(with_geo_key(df, lat_col, lon_col))
    known = F.col("lat_e4").isNotNull() & F.col("lon_e4").isNotNull()
    found = left_join_on_keys(keyed.where(known), table.keyed().withColumnRenamed("location", out_col), ["lat_e4", "lon_e4"])
    every = found.select(*keyed.columns, out_col).unionByName(keyed.where(~known).withColumn(out_col, F.lit(None).cast("string")))
    return every.select(*KEYS, *[c for c in df.columns if c not in KEYS], out_col)


def missing_keys(df: DataFrame, cache: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Distinct keys of rows with coordinates that the cache does not know."""
    keys = (with_geo_key(df, lat_col, lon_col).where(F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull())
            .select(*KEYS).distinct())
    return keys.join(cache.select(*KEYS), KEYS, "left_anti")


def resolve_responses(responses: DataFrame, lat_col: str = "lat", lon_col: str = "lon",
                      components_col: str = "components") -> DataFrame:
    """One location per key: first non-empty of the response fields, else 'Unknown'."""
    comp = F.col(components_col)
    name = F.coalesce(first_non_empty(*[comp.getItem(k) for k in LOCATION_FIELDS]), F.lit(UNKNOWN_LOCATION))
    keyed = responses.select(geo_key(lat_col).alias("lat_key"), geo_key(lon_col).alias("lon_key"),
                             name.alias("location"))
    # several responses for one key: keep one deterministic answer
    return keyed.groupBy(*KEYS).agg(F.min("location").alias("location"))


def update_cache(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """K8 (logical part): cache plus the resolved keys it did not hold yet."""
    new = resolved.join(cache.select(*KEYS), KEYS, "left_anti")
    return cache.select(*KEYS, "location").unionByName(new.select(*KEYS, "location"))


def enrich_location(df: DataFrame, cache: DataFrame, id_cols: Sequence[str] | None = None,
                    lat_col: str = "latitude", lon_col: str = "longitude", loc_col: str = "location",
                    limit: int | None = None, responses: DataFrame | None = None) -> DataFrame:
    """Fill ``loc_col`` where it is missing.

    * existing values are kept (P6); the column is added when absent (P5);
    * missing coordinates -> 'Unknown' without a lookup (P7);
    * otherwise the cached name, else the resolved response, else NULL;
    * ``limit``: only the first ``limit`` unresolved rows in ``id_cols`` order
      are processed (cache hits and missing coordinates count too); later rows
      keep NULL (J4).
    """
    out = df if loc_col in df.columns else df.withColumn(loc_col, F.lit(None).cast("string"))
    table = cache.select(*KEYS, "location")
    if responses is not None:
        table = update_cache(table, resolve_responses(responses))
    keyed = with_geo_key(out, lat_col, lon_col)
    no_coord = F.col(lat_col).isNull() | F.col(lon_col).isNull()
    found = F.when(no_coord, F.lit(UNKNOWN_LOCATION)).otherwise(F.col("_found"))
    todo = F.col(loc_col).isNull()
    if limit is not None:
        if not id_cols:
            raise ValueError("limit needs id_cols to define row order")
        # The budget's rows are a top-``limit`` by id (a bounded heap in every task); only they are looked up. They are marked
        # by a row key, as ids may be null or repeated; the keyed rows are written once, so the row keys hold for both reads.
        keyed = cut_lineage(keyed.withColumn("_row", F.monotonically_increasing_id()))
        first = keyed.where(todo).select(*id_cols, "_row").orderBy(*id_cols, "_row").limit(limit).select("_row")
        first = cut_lineage(first) if limit > BROADCAST_IDS else F.broadcast(first)
        marked = keyed.join(first.withColumn("_due", F.lit(True)), "_row", "left")
        due = F.coalesce(F.col("_due"), F.lit(False)) & todo
        joined = _join_cache(marked.where(due), table, "_found")
        joined = joined.withColumn("_found", found).unionByName(
            marked.where(~due).withColumn("_found", F.lit(None).cast("string")))
        found = F.col("_found")
    else:
        joined = _join_cache(keyed, table, "_found")
    result = joined.withColumn(loc_col, F.coalesce(F.col(loc_col), F.when(todo, found)))
    return result.drop("_found", *KEYS).select(*out.columns)
