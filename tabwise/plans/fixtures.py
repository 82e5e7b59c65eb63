"""Inputs for the registered queries, derived from the driver tables.

Each derivation exists twice: as a DataFrame (what the query runs on) and as
a SQL common table expression with the same rows (what the DuckDB oracle
runs on). Missing values are injected with the same expression on both sides
because the driver tables contain none; no rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import TRIM_PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_if(cond, c):
    return F.when(cond, F.lit(None)).otherwise(F.col(c) if isinstance(c, str) else c)


# -- orders with injected missing values ------------------------------------------------
def orders_nulls(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        _null_if(k % 7 == 0, "o_custkey").alias("o_custkey"),
        "o_orderstatus",
        _null_if(k % 5 == 0, "o_totalprice").alias("o_totalprice"),
        _null_if(k % 11 == 0, "o_orderpriority").alias("o_orderpriority"),
    )


ORDERS_NULLS_SQL = """orders_n AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


# -- events numerics (heavy-tailed value) with injected missing values --------------------
def events_numeric(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "value", "user_id",
                    _null_if(F.col("event_id") % 9 == 0, "value").alias("value_n"))


EVENTS_NUMERIC_SQL = """events_x AS (
  SELECT event_id, value, user_id,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value_n
  FROM events)"""


# -- lineitem's numbers in each month of shipping: 48 columns, empty outside their month -----
_WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_wide(spark, d) -> DataFrame:
    """One column for each number and shipping month, present in half a year from that month on."""
    month = F.month("l_shipdate")
    return table(spark, d, "lineitem").select(*[
        F.when((month - m + 12) % 12 < 6, F.col(c)).alias(f"{c}_{m}") for c in _WIDE for m in range(1, 13)])


WIDE_COLS = [f"{c}_{m}" for c in _WIDE for m in range(1, 13)]
LINEITEM_WIDE_SQL = "wide AS (SELECT " + ", ".join(
    f"CASE WHEN (month(l_shipdate) - {m} + 12) % 12 < 6 THEN {c}::DOUBLE END AS {c}_{m}" for c in _WIDE for m in range(1, 13)) + " FROM lineitem)"


# -- lineitem with a null-injected copy and a constant column ----------------------------
def lineitem_corr(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount",
                     _null_if(F.col("l_orderkey") % 3 == 0, "l_quantity").alias("qty_n"),
                     F.lit(1.0).alias("const_one"))


LINEITEM_CORR_SQL = """li_c AS (
  SELECT l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS qty_n,
         CAST(1.0 AS DOUBLE) AS const_one
  FROM lineitem)"""


# -- comma lists from whole document texts -----------------------------------------------
def doc_sources(spark, d) -> DataFrame:
    k = F.col("doc_id")
    src = (F.when(k % 5 == 0, F.concat(F.lit("'"), F.col("text"), F.lit("'")))
           .when(k % 11 == 0, F.lit(None))
           .when(k % 13 == 0, F.lit(" , ,"))
           .otherwise(F.col("text")))
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars", src.alias("src"))


DOC_SOURCES_SQL = """docs_s AS (
  SELECT doc_id, lang, n_chars,
         CASE WHEN doc_id % 5 = 0 THEN '''' || text || ''''
              WHEN doc_id % 11 = 0 THEN NULL
              WHEN doc_id % 13 = 0 THEN ' , ,'
              ELSE text END AS src
  FROM documents)"""

TRIM_SQL = TRIM_PATTERN.replace("'", "''")


# -- pseudo predictions on lineitem (metrics need no trained model) ----------------------
def scored_lineitem(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    pred = (F.when(F.col("l_discount") == 0, "X").when(F.col("l_quantity") < 17, "A")
            .when(F.col("l_quantity") < 34, "N").otherwise("R"))
    return li.select(
        F.col("l_returnflag").alias("label"),
        pred.alias("prediction"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y_pred"),
        (F.col("l_discount") * 10 + F.col("l_tax")).alias("score"),
        (F.col("l_linenumber") - 1).alias("fold"),
    )


def scored_fine(spark, d) -> DataFrame:
    """Line items with a score of thousands of distinct values that orders the classes unevenly (runs of one class occur)."""
    li = table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
                     F.when(F.col("l_returnflag") == "R", F.round(F.col("l_extendedprice"), 0)).otherwise(
                         F.round(F.col("l_extendedprice") / 10, 0) * 10).alias("score"))


SCORED_FINE_SQL = """scored AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice, 0) ELSE round(l_extendedprice / 10, 0) * 10 END AS score
  FROM lineitem)"""


SCORED_LINEITEM_SQL = """scored AS (
  SELECT l_returnflag AS label,
         CASE WHEN l_discount = 0 THEN 'X' WHEN l_quantity < 17 THEN 'A'
              WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y_pred,
         l_discount * 10 + l_tax AS score,
         l_linenumber - 1 AS fold
  FROM lineitem)"""


# -- supplier points, location cache and reverse-lookup responses ------------------------
def supplier_points(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        "s_suppkey",
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("s_acctbal") / 130.0).alias("latitude"),
        (F.col("s_nationkey").cast("double") * 1.5).alias("longitude"),
        F.when(k % 3 == 0, F.lit("PRESET")).otherwise(F.lit(None).cast("string")).alias("location"),
    )


SUPPLIER_POINTS_SQL = """pts AS (
  SELECT s_suppkey,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal / 130.0 END AS latitude,
         CAST(s_nationkey AS DOUBLE) * 1.5 AS longitude,
         CASE WHEN s_suppkey % 3 = 0 THEN 'PRESET' ELSE NULL END AS location
  FROM supplier)"""


def location_cache(spark, d) -> DataFrame:
    """Cache known for the suppliers of regions 0 and 1 (a partly filled lookup table)."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).where(F.col("n_regionkey") < 2)
    return j.select(F.round(F.col("s_acctbal") / 130.0, 4).alias("lat_key"),
                    F.round(F.col("s_nationkey").cast("double") * 1.5, 4).alias("lon_key"),
                    F.col("n_name").alias("location")).groupBy("lat_key", "lon_key").agg(
        F.min("location").alias("location"))


LOCATION_CACHE_SQL = """cache AS (
  SELECT round(s_acctbal / 130.0, 4) AS lat_key,
         round(CAST(s_nationkey AS DOUBLE) * 1.5, 4) AS lon_key,
         min(n_name) AS location
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE n_regionkey < 2
  GROUP BY 1, 2)"""


def location_responses(spark, d) -> DataFrame:
    """Answers of an external reverse lookup for every supplier point."""
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    country = F.when(k % 3 == 0, F.lit("")).otherwise(F.col("n_name"))
    water = F.when(k % 2 == 0, F.concat(F.lit("SEA_"), F.col("r_name"))).otherwise(F.lit(None).cast("string"))
    return j.select((F.col("s_acctbal") / 130.0).alias("lat"),
                    (F.col("s_nationkey").cast("double") * 1.5).alias("lon"),
                    F.create_map(F.lit("country"), country, F.lit("body_of_water"), water).alias("components"))


LOCATION_RESPONSES_SQL = """resp AS (
  SELECT round(s_acctbal / 130.0, 4) AS lat_key,
         round(CAST(s_nationkey AS DOUBLE) * 1.5, 4) AS lon_key,
         min(coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END, ''),
                      nullif(CASE WHEN s_suppkey % 2 = 0 THEN 'SEA_' || r_name ELSE NULL END, ''),
                      'Unknown')) AS location
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""


# -- every order's customer as a point; a cache that knows the points of some regions --------
def order_points(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey", _null_if(F.col("o_orderkey") % 4 == 0, F.col("c_acctbal") / 130.0).alias("latitude"),
        (F.col("c_nationkey").cast("double") * 1.5).alias("longitude"))


ORDER_POINTS_SQL = """pts_o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_acctbal / 130.0 END AS latitude,
         CAST(c_nationkey AS DOUBLE) * 1.5 AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def customer_cache(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).where("n_regionkey < 3").select(
        F.round(F.col("c_acctbal") / 130.0, 4).alias("lat_key"),
        F.round(F.col("c_nationkey").cast("double") * 1.5, 4).alias("lon_key"), F.col("n_name").alias("location"))


CUSTOMER_CACHE_SQL = """cache_c AS (
  SELECT round(c_acctbal / 130.0, 4) AS lat_key, round(CAST(c_nationkey AS DOUBLE) * 1.5, 4) AS lon_key, min(n_name) AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY 1, 2)"""


# -- categorical events for ordinal encoding ---------------------------------------------
def events_categorical(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("etype"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("ubucket"),
    )


EVENTS_CATEGORICAL_SQL = """ev_c AS (
  SELECT event_id,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS etype,
         'u' || CAST(user_id % 10 AS VARCHAR) AS ubucket
  FROM events)"""


# -- orders as a classification table (unique id, numeric features, binary label) -------
def orders_learning(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.year("o_orderdate").cast("double").alias("year"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 100).cast("double")
        .alias("cust_bucket"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
    )


def orders_separable(spark, d) -> DataFrame:
    """As ``orders_learning``, but the label follows from one feature: the right answer of a learner is known.

    ``y``: priority 1 or 2; ``kind``: three text classes by priority.
    """
    p = F.col("priority")
    kind = F.when(p <= 2, "high").when(p == 3, "mid").otherwise("low")
    return orders_learning(spark, d).withColumn("y", (p <= 2).cast("int")).withColumn("kind", kind)


ORDERS_SEPARABLE_SQL = """sep AS (
  SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 1 ELSE 0 END AS y,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'high'
              WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = 3 THEN 'mid' ELSE 'low' END AS kind
  FROM orders)"""


LEARN_FEATURES = ["price", "month", "year", "priority", "cust_bucket"]


def orders_points(spark, d) -> DataFrame:
    """Two scaled features per order, class = order status (for kNN / SMOTE / ENN)."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 100000.0).alias("f1"),
                    F.month("o_orderdate").cast("double").alias("f2"))


ORDERS_POINTS_SQL = """pts AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice / 100000.0 AS f1, CAST(month(o_orderdate) AS DOUBLE) AS f2
  FROM orders)"""
