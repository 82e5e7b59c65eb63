"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same rows. Learners are registered on a label
that one feature decides, so that SQL can state the right answer.

Every query reads whole driver tables (or data Spark derives from them);
numeric outputs are rounded to 6 decimals on both sides so that engine-level
floating-point summation order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, encode, locate, metrics, prep, profile, split
from ..operators.search import DEFAULT_BOUNDS, DRAWS
from ..session import cut_lineage
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 decimals."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ======================================================================================
# Profiling
# ======================================================================================
_ON_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@register("eda_missing", _with(fx.ORDERS_NULLS_SQL) + "SELECT column_name, n_missing FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM orders_n" for c in _ON_COLS)
    + ") WHERE n_missing > 0")
def q_eda_missing(spark, d):
    return profile.missing_counts(fx.orders_nulls(spark, d))


@register("eda_missing_map", _with(fx.ORDERS_NULLS_SQL) + "\nUNION ALL\n".join(
    f"SELECT o_orderkey // 1000 AS bucket, '{c}' AS column_name, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_share FROM orders_n GROUP BY 1"
    for c in _ON_COLS))
def q_eda_missing_map(spark, d):
    o = fx.orders_nulls(spark, d)
    return r6(profile.missing_map(o, F.floor(F.col("o_orderkey") / 1000).cast("long"), _ON_COLS))


_EV_COLS = ["value", "user_id", "value_n"]
_EV_LONG = "ev_long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM events_x WHERE {c} IS NOT NULL" for c in _EV_COLS) + ")"
_EV_Q = """ev_q AS (SELECT column_name, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
                       quantile_cont(x, 0.75) AS q3 FROM ev_long GROUP BY 1),
ev_f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ev_q)"""


@register("eda_outliers", _with(fx.EVENTS_NUMERIC_SQL, _EV_LONG, _EV_Q) + """
SELECT column_name, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
       round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper,
       count(*) FILTER (WHERE x < lo OR x > hi) AS n_outliers
FROM ev_f JOIN ev_long USING (column_name) GROUP BY column_name""")
def q_eda_outliers(spark, d):
    return r6(profile.outlier_counts(fx.events_numeric(spark, d), _EV_COLS))


@register("eda_box_stats", _with(fx.EVENTS_NUMERIC_SQL, _EV_LONG, _EV_Q) + """
SELECT column_name, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
       round(min(x) FILTER (WHERE x >= lo AND x <= hi), 6) AS whisker_low,
       round(max(x) FILTER (WHERE x >= lo AND x <= hi), 6) AS whisker_high
FROM ev_f JOIN ev_long USING (column_name) GROUP BY column_name""")
def q_eda_box_stats(spark, d):
    return r6(profile.box_stats(fx.events_numeric(spark, d), _EV_COLS))


@register("eda_class_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_eda_class_counts(spark, d):
    return profile.class_counts(fx.table(spark, d, "lineitem"), "l_returnflag")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "qty_n", "const_one"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i:]:
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            r = (f"CASE WHEN stddev_pop({xa}) * stddev_pop({xb}) = 0 THEN NULL "
                 f"ELSE covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})) END")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({r}, 6) AS corr FROM li_c")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, round({r}, 6) AS corr FROM li_c")
    return _with(fx.LINEITEM_CORR_SQL) + "\nUNION ALL\n".join(parts)


@register("eda_correlation", _corr_sql())
def q_eda_correlation(spark, d):
    return r6(profile.correlation(fx.lineitem_corr(spark, d), _CORR_COLS))


_SKETCHED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("eda_sketch_quantiles", "WITH " + ", ".join(f"""
p{i} AS (SELECT '{c}' AS column_name, count(CASE WHEN l_orderkey % 6 <> 0 THEN {c} END) AS n, quantile_cont(CASE WHEN l_orderkey % 6 <> 0 THEN {c} END, [0.25, 0.5, 0.75]) AS q FROM lineitem)""" for i, c in enumerate(_SKETCHED)) + """,
u AS (""" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(_SKETCHED))) + """),
r AS (SELECT column_name, n, unnest([0.25, 0.5, 0.75])::DOUBLE AS p, unnest(q) AS exact FROM u)
SELECT column_name, p, n, round(exact, 6) AS exact, true AS within FROM r""")
def q_eda_sketch_quantiles(spark, d):
    """A3's quartiles from KLL sketches kept by shipping month and merged, beside the exact ones, and whether each one's rank is within the sketch's error."""
    from ..operators import sketches as sk
    from ..operators.quantiles import exact_quantiles
    li = fx.table(spark, d, "lineitem").select("l_shipdate", *[F.when(F.col("l_orderkey") % 6 != 0, F.col(c)).alias(c) for c in _SKETCHED])
    parts = cut_lineage(sk.sketch_parts(li, _SKETCHED, F.date_trunc("month", "l_shipdate")))
    probs = [0.25, 0.5, 0.75]
    found = sk.sketch_quantiles(sk.merge_parts(parts), probs)
    at = {(r.column_name, r.p): r.value for r in found.collect()}  # three numbers a column
    row = li.agg(*[f(F.when(test, 1)).alias(f"{side}{i}") for i, (c, p) in enumerate(at) for side, f, test in (
        ("under", F.count, F.col(c) < at[c, p]), ("upto", F.count, F.col(c) <= at[c, p]))]).first()
    ranks = spark.createDataFrame([(c, p, row[f"under{i}"], row[f"upto{i}"]) for i, (c, p) in enumerate(at)], "column_name STRING, p DOUBLE, under LONG, upto LONG")
    error = sk.rank_error() + 1 / F.col("n")
    within = (F.col("under") <= (F.col("p") + error) * F.col("n")) & (F.col("upto") >= (F.col("p") - error) * F.col("n"))
    exact = exact_quantiles(li, _SKETCHED, probs).select("column_name", "p", F.col("value").alias("exact"))
    return r6(found.join(ranks, ["column_name", "p"]).join(exact, ["column_name", "p"]).select("column_name", "p", "n", "exact", within.alias("within")))


_WIDE_PAIRS = [(a, b) for i, a in enumerate(fx.WIDE_COLS) for b in fx.WIDE_COLS[i:]]


@register("eda_correlation_wide", _with(fx.LINEITEM_WIDE_SQL, "r AS (SELECT [" + ", ".join(
    f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END)" for a, b in _WIDE_PAIRS) + "] AS r FROM wide)",
    "p AS (SELECT unnest([" + ", ".join(f"['{a}', '{b}']" for a, b in _WIDE_PAIRS) + "]) AS p, unnest(r) AS c FROM r)") + """
SELECT p[1] AS col_a, p[2] AS col_b, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS corr FROM p
UNION ALL SELECT p[2], p[1], round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) FROM p WHERE p[1] <> p[2]""")
def q_eda_correlation_wide(spark, d):
    """1,176 pairs of partly empty columns, from one Gram matrix."""
    return r6(profile.correlation(fx.lineitem_wide(spark, d), fx.WIDE_COLS))


@register("eda_duplicates", """
WITH l AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM l GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"))
def q_eda_duplicates(spark, d):
    """Whole rows; the rows of every tenth order occur twice."""
    li = fx.table(spark, d, "lineitem")
    return profile.duplicate_count(li.unionByName(li.where(F.col("l_orderkey") % 10 == 0)))


@register("label_universe", "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def q_label_universe(spark, d):
    return profile.label_universe(fx.table(spark, d, "events"), "event_type")


@register("union_train_test", """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, NULL::VARCHAR AS o_orderpriority
FROM orders WHERE o_orderkey % 2 = 0
UNION ALL
SELECT o_orderkey, NULL::DOUBLE AS o_totalprice, o_orderstatus, o_orderpriority
FROM orders WHERE o_orderkey % 2 = 1""")
def q_union_train_test(spark, d):
    o = fx.table(spark, d, "orders")
    train = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_totalprice", "o_orderstatus")
    test = o.where(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return r6(profile.union_train_test(train, test))


# ======================================================================================
# Projections and cleaning
# ======================================================================================
@register("feature_target_select", "SELECT round(c_acctbal, 6) AS c_acctbal, c_nationkey, c_mktsegment FROM customer")
def q_feature_target_select(spark, d):
    return r6(clean.feature_target_select(fx.table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"))


@register("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def q_drop_columns(spark, d):
    return r6(clean.drop_columns(fx.table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"]))


@register("stringify_nulls", _with(fx.ORDERS_NULLS_SQL) + """
SELECT o_orderkey, coalesce(o_orderstatus, 'nan') AS o_orderstatus, coalesce(o_orderpriority, 'nan') AS o_orderpriority
FROM orders_n""")
def q_stringify_nulls(spark, d):
    o = fx.orders_nulls(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.stringify_nulls(o)


@register("project_selected", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def q_project_selected(spark, d):
    return clean.project_selected(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity",
                                                                   "l_discount"])


@register("head_preview", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5""")
def q_head_preview(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return r6(clean.head_preview(o, ["o_orderkey"], 5))


@register("safe_float", """
SELECT event_id, round(CASE WHEN isnan(v) THEN NULL ELSE v END, 6) AS parsed FROM (
  SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN props
                                 WHEN event_id % 4 = 1 THEN ' ' || regexp_extract(props, '[0-9]+') || ' '
                                 ELSE regexp_extract(props, '[0-9]+') || '.5' END AS DOUBLE) AS v
  FROM events)""")
def q_safe_float(spark, d):
    e = fx.table(spark, d, "events")
    num = F.regexp_extract("props", "[0-9]+", 0)
    txt = (F.when(F.col("event_id") % 4 == 0, F.col("props"))
           .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), num, F.lit(" ")))
           .otherwise(F.concat(num, F.lit(".5"))))
    return r6(clean.parse_float(e.select("event_id", txt.alias("parsed")), ["parsed"]))


@register("sanitise_negative", """
WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN med ELSE c_acctbal END, 6) AS c_acctbal FROM customer, m""")
def q_sanitise_negative(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    train = c.where(F.col("c_custkey") % 5 != 0)
    med = prep.column_medians(train, ["c_acctbal"])["c_acctbal"]
    return r6(clean.sanitise_negative(c, "c_acctbal", med))


_COUNT_ITEMS = ("len(list_filter(list_transform(string_split({s}, ','), lambda e: regexp_replace(e, '" + fx.TRIM_SQL
                + "', '', 'g')), lambda e: e <> ''))")


@register("count_sources", _with(fx.DOC_SOURCES_SQL) + "SELECT doc_id, lang, n_chars, CAST("
          + _COUNT_ITEMS.replace("{s}", "regexp_replace(coalesce(src, ''), '^''+|''+$', '', 'g')")
          + " AS BIGINT) AS source_counter FROM docs_s")
def q_count_sources(spark, d):
    return clean.count_sources(fx.doc_sources(spark, d), "src")


@register("count_sources_scoring", _with(fx.DOC_SOURCES_SQL)
          + "SELECT doc_id, lang, n_chars, CASE WHEN coalesce(regexp_replace(src, '" + fx.TRIM_SQL
          + "', '', 'g'), '') = '' THEN NULL ELSE CAST(" + _COUNT_ITEMS.replace("{s}", "src")
          + " AS BIGINT) END AS source_counter FROM docs_s")
def q_count_sources_scoring(spark, d):
    return clean.count_sources_scoring(fx.doc_sources(spark, d), "src")


# ======================================================================================
# Location enrichment
# ======================================================================================
_KEYS_SQL = "round(latitude, 4) AS lat_key, round(longitude, 4) AS lon_key"


@register("geo_key", _with(fx.SUPPLIER_POINTS_SQL) + f"SELECT s_suppkey, {_KEYS_SQL} FROM pts")
def q_geo_key(spark, d):
    return locate.with_geo_key(fx.supplier_points(spark, d)).select("s_suppkey", "lat_key", "lon_key")


@register("locate_lookup", _with(fx.SUPPLIER_POINTS_SQL, fx.LOCATION_CACHE_SQL) + f"""
SELECT p.s_suppkey, c.location AS cached_location
FROM (SELECT s_suppkey, {_KEYS_SQL} FROM pts) p LEFT JOIN cache c USING (lat_key, lon_key)""")
def q_locate_lookup(spark, d):
    out = locate.lookup(fx.supplier_points(spark, d), fx.location_cache(spark, d))
    return out.select("s_suppkey", "cached_location")


@register("locate_missing_keys", _with(fx.SUPPLIER_POINTS_SQL, fx.LOCATION_CACHE_SQL) + f"""
SELECT DISTINCT k.lat_key, k.lon_key
FROM (SELECT {_KEYS_SQL} FROM pts WHERE latitude IS NOT NULL AND longitude IS NOT NULL) k
ANTI JOIN cache c USING (lat_key, lon_key)""")
def q_locate_missing_keys(spark, d):
    return locate.missing_keys(fx.supplier_points(spark, d), fx.location_cache(spark, d))


@register("locate_resolve", _with(fx.LOCATION_RESPONSES_SQL) + "SELECT lat_key, lon_key, location FROM resp")
def q_locate_resolve(spark, d):
    return locate.resolve_responses(fx.location_responses(spark, d))


_TABLE_SQL = """tbl AS (SELECT lat_key, lon_key, location FROM cache
               UNION ALL
               SELECT lat_key, lon_key, location FROM resp ANTI JOIN cache USING (lat_key, lon_key)),
j AS (SELECT p.s_suppkey, p.latitude, p.longitude, p.location,
             CASE WHEN p.latitude IS NULL OR p.longitude IS NULL THEN 'Unknown' ELSE t.location END AS found
      FROM (SELECT *, {keys} FROM pts) p LEFT JOIN tbl t USING (lat_key, lon_key))""".format(keys=_KEYS_SQL)


@register("locate_null_coords", _with(fx.SUPPLIER_POINTS_SQL, fx.LOCATION_CACHE_SQL) + f"""
SELECT p.s_suppkey,
       CASE WHEN p.latitude IS NULL OR p.longitude IS NULL THEN 'Unknown' ELSE c.location END AS location
FROM (SELECT s_suppkey, latitude, longitude, {_KEYS_SQL} FROM pts) p LEFT JOIN cache c USING (lat_key, lon_key)""")
def q_locate_null_coords(spark, d):
    pts = fx.supplier_points(spark, d).drop("location")
    out = locate.enrich_location(pts, fx.location_cache(spark, d))
    return out.select("s_suppkey", "location")


@register("locate_keep_existing", _with(fx.SUPPLIER_POINTS_SQL, fx.LOCATION_CACHE_SQL, fx.LOCATION_RESPONSES_SQL,
                                        _TABLE_SQL) + "SELECT s_suppkey, coalesce(location, found) AS location FROM j")
def q_locate_keep_existing(spark, d):
    out = locate.enrich_location(fx.supplier_points(spark, d), fx.location_cache(spark, d),
                                 responses=fx.location_responses(spark, d))
    return out.select("s_suppkey", "location")


# Fixed value: per-run lookup budget of the budget query (the feature under test).
BUDGET = 40


@register("locate_budget", _with(fx.SUPPLIER_POINTS_SQL, fx.LOCATION_CACHE_SQL, fx.LOCATION_RESPONSES_SQL,
                                 _TABLE_SQL) + f"""
SELECT s_suppkey, location FROM j WHERE location IS NOT NULL
UNION ALL
SELECT s_suppkey, CASE WHEN rn <= {BUDGET} THEN found END AS location
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM j WHERE location IS NULL)""")
def q_locate_budget(spark, d):
    out = locate.enrich_location(fx.supplier_points(spark, d), fx.location_cache(spark, d), id_cols=["s_suppkey"],
                                 limit=BUDGET, responses=fx.location_responses(spark, d))
    return out.select("s_suppkey", "location")


@register("cache_import", """
SELECT round(s_acctbal / 130.0, 4) AS lat_key, round(CAST(s_nationkey AS DOUBLE) * 1.5, 4) AS lon_key,
       n_name AS location
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_cache_import(spark, d):
    from ..sources import import_json_cache
    s, n = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    lat = F.round(F.col("s_acctbal") / 130.0, 4).cast("string")
    lon = F.round(F.col("s_nationkey").cast("double") * 1.5, 4).cast("string")
    # one old-style JSON cache object per row: {"(lat, lon)": "name"}
    text = F.to_json(F.create_map(F.concat(F.lit("("), lat, F.lit(", "), lon, F.lit(")")), F.col("n_name")))
    return import_json_cache(j.select(text.alias("value")))


# ======================================================================================
# Ordinal encoding
# ======================================================================================
_ENC_FIT_SQL = """fitset AS (SELECT * FROM ev_c WHERE etype IS DISTINCT FROM 'view'),
mapping AS (
  SELECT column_name, category,
         CAST(row_number() OVER (PARTITION BY column_name ORDER BY category ASC NULLS LAST) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT 'etype' AS column_name, etype AS category FROM fitset
        UNION SELECT DISTINCT 'ubucket', ubucket FROM fitset))"""


def _enc_train(spark, d):
    ev = fx.events_categorical(spark, d)
    return ev, ev.where(~F.col("etype").eqNullSafe("view"))


@register("ordinal_fit", _with(fx.EVENTS_CATEGORICAL_SQL, _ENC_FIT_SQL) + "SELECT column_name, category, code FROM mapping")
def q_ordinal_fit(spark, d):
    _, train = _enc_train(spark, d)
    return encode.fit_ordinal(train, ["etype", "ubucket"])


@register("ordinal_transform", _with(fx.EVENTS_CATEGORICAL_SQL, _ENC_FIT_SQL) + """
SELECT e.event_id, coalesce(a.code, -1.0) AS etype, coalesce(b.code, -1.0) AS ubucket
FROM ev_c e
LEFT JOIN (SELECT * FROM mapping WHERE column_name = 'etype') a ON e.etype IS NOT DISTINCT FROM a.category
LEFT JOIN (SELECT * FROM mapping WHERE column_name = 'ubucket') b ON e.ubucket IS NOT DISTINCT FROM b.category""")
def q_ordinal_transform(spark, d):
    ev, train = _enc_train(spark, d)
    _, test_enc, _ = encode.encode(train, ["etype", "ubucket"], ev)
    return test_enc


# ======================================================================================
# Imputation, scaling, router
# ======================================================================================
@register("impute_median", _with(fx.ORDERS_NULLS_SQL) + """
, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS mp, quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS mc FROM orders_n)
SELECT o_orderkey, round(coalesce(o_totalprice, mp), 6) AS o_totalprice,
       round(coalesce(CAST(o_custkey AS DOUBLE), mc), 6) AS o_custkey
FROM orders_n, m""")
def q_impute_median(spark, d):
    o = fx.orders_nulls(spark, d).select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    model = prep.fit_prep(o, prep.PrepSpec(["o_totalprice", "o_custkey"], [], "median", None))
    return r6(model.transform(o).select("o_orderkey", "o_totalprice", "o_custkey"))


@register("impute_mean", _with(fx.ORDERS_NULLS_SQL) + """
, m AS (SELECT avg(o_totalprice) AS mp, avg(CAST(o_custkey AS DOUBLE)) AS mc FROM orders_n)
SELECT o_orderkey, round(coalesce(o_totalprice, mp), 6) AS o_totalprice,
       round(coalesce(CAST(o_custkey AS DOUBLE), mc), 6) AS o_custkey
FROM orders_n, m""")
def q_impute_mean(spark, d):
    o = fx.orders_nulls(spark, d).select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    model = prep.fit_prep(o, prep.PrepSpec(["o_totalprice", "o_custkey"], [], "mean", None))
    return r6(model.transform(o).select("o_orderkey", "o_totalprice", "o_custkey"))


@register("impute_mode", _with(fx.ORDERS_NULLS_SQL) + """
, m AS (SELECT o_orderpriority AS v FROM orders_n WHERE o_orderpriority IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, v) AS o_orderpriority FROM orders_n, m""")
def q_impute_mode(spark, d):
    o = fx.orders_nulls(spark, d).select("o_orderkey", "o_orderpriority")
    model = prep.fit_prep(o, prep.PrepSpec([], ["o_orderpriority"]))
    return model.transform(o).select("o_orderkey", "o_orderpriority")


@register("robust_scale", """
WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m1, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS i1,
                  quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5) AS m2,
                  quantile_cont(CAST(c_nationkey AS DOUBLE), 0.75) - quantile_cont(CAST(c_nationkey AS DOUBLE), 0.25) AS i2
           FROM customer)
SELECT c_custkey, round((c_acctbal - m1) / CASE WHEN i1 = 0 THEN 1 ELSE i1 END, 6) AS c_acctbal,
       round((CAST(c_nationkey AS DOUBLE) - m2) / CASE WHEN i2 = 0 THEN 1 ELSE i2 END, 6) AS c_nationkey
FROM customer, m""")
def q_robust_scale(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double"))
    model = prep.fit_prep(c, prep.PrepSpec(["c_acctbal", "c_nationkey"], [], None, "robust"))
    return r6(model.transform(c))


@register("column_router", _with(fx.ORDERS_NULLS_SQL) + """
, oc AS (SELECT o.o_orderkey, o.o_totalprice, CAST(c.c_nationkey AS DOUBLE) AS c_nationkey, c.c_acctbal
         FROM orders_n o JOIN customer c ON o.o_custkey = c.c_custkey),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM oc),
md AS (SELECT c_nationkey AS v FROM oc GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1)
SELECT round(coalesce(o_totalprice, med), 6) AS o_totalprice, round(coalesce(c_nationkey, v), 6) AS c_nationkey,
       o_orderkey, round(c_acctbal, 6) AS c_acctbal
FROM oc, m, md""")
def q_column_router(spark, d):
    o = fx.orders_nulls(spark, d)
    c = fx.table(spark, d, "customer")
    oc = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey", "o_totalprice", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal")
    model = prep.fit_prep(oc, prep.PrepSpec(["o_totalprice"], ["c_nationkey"], "median", None))
    return r6(model.transform(oc))


# ======================================================================================
# Stratified split and folds
# ======================================================================================
_SPLIT_RANK_SQL = """r AS (
  SELECT o_orderkey, o_orderstatus,
         row_number() OVER (PARTITION BY o_orderstatus
                            ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rn
  FROM orders)"""


@register("stratified_split", _with(_SPLIT_RANK_SQL) + """
, c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS nt FROM c),
b AS (SELECT o_orderstatus, (n * nt) // total AS base, (n * nt) % total AS rem FROM c, t),
q AS (SELECT o_orderstatus,
             base + CASE WHEN row_number() OVER (ORDER BY rem DESC, o_orderstatus)
                              <= (SELECT nt FROM t) - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota
      FROM b)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q USING (o_orderstatus)""")
def q_stratified_split(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(o, "o_orderstatus", ["o_orderkey"], 0.2, 42)


@register("stratified_folds", _with(_SPLIT_RANK_SQL) + """
, c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
off AS (SELECT o_orderstatus, coalesce(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
        FROM c)
SELECT o_orderkey, o_orderstatus, CAST((o + rn - 1) % 5 AS BIGINT) AS fold FROM r JOIN off USING (o_orderstatus)""")
def q_stratified_folds(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = split.stratified_folds(o, "o_orderstatus", ["o_orderkey"], 5, 42)
    return out.withColumn("fold", F.col("fold").cast("long"))


# ======================================================================================
# Metrics on pseudo predictions
# ======================================================================================
_CELLS = """cells AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM scored GROUP BY 1, 2),
roles AS (SELECT label, sum(s) AS support, sum(p) AS n_predicted, sum(tp) AS tp FROM (
            SELECT actual AS label, n AS s, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM cells
            UNION ALL SELECT predicted, 0, n, 0 FROM cells) GROUP BY label),
prf AS (SELECT label, CAST(support AS BIGINT) AS support,
               CASE WHEN n_predicted = 0 THEN 0.0 ELSE tp / n_predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + n_predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + n_predicted) END AS f1
        FROM roles)"""


@register("metric_accuracy", _with(fx.SCORED_LINEITEM_SQL) + """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored""")
def q_metric_accuracy(spark, d):
    return r6(metrics.accuracy(fx.scored_lineitem(spark, d)))


@register("metric_confusion", _with(fx.SCORED_LINEITEM_SQL) + """
, u AS (SELECT label AS l FROM scored UNION SELECT prediction FROM scored),
cells AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT a.l AS actual, p.l AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM u a CROSS JOIN u p LEFT JOIN cells c ON c.actual = a.l AND c.predicted = p.l""")
def q_metric_confusion(spark, d):
    return metrics.confusion(fx.scored_lineitem(spark, d))


@register("metric_per_class", _with(fx.SCORED_LINEITEM_SQL, _CELLS) + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf""")
def q_metric_per_class(spark, d):
    return r6(metrics.per_class(fx.scored_lineitem(spark, d)))


@register("metric_report", _with(fx.SCORED_LINEITEM_SQL, _CELLS) + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf
UNION ALL
SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM scored), 6),
       CAST(sum(support) AS BIGINT) FROM prf
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
FROM prf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf""")
def q_metric_report(spark, d):
    return r6(metrics.report(fx.scored_lineitem(spark, d)))


@register("metric_macro_f1", _with(fx.SCORED_LINEITEM_SQL, _CELLS) + "SELECT round(avg(f1), 6) AS macro_f1 FROM prf")
def q_metric_macro_f1(spark, d):
    return r6(metrics.macro_f1(fx.scored_lineitem(spark, d)))


@register("metric_binary_f1", _with(fx.SCORED_LINEITEM_SQL) + """
, c AS (SELECT sum(CASE WHEN y = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS pr FROM scored)
SELECT round(CASE WHEN sup + pr = 0 THEN 0.0 ELSE 2.0 * tp / (sup + pr) END, 6) AS binary_f1 FROM c""")
def q_metric_binary_f1(spark, d):
    return r6(metrics.binary_f1(fx.scored_lineitem(spark, d), "y", "y_pred", 1))


_SCORES = """st AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored WHERE score IS NOT NULL GROUP BY score)"""


@register("metric_roc_points", _with(fx.SCORED_LINEITEM_SQL, _SCORES) + """
, c AS (SELECT score, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM st
        WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM st)
SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT round(score, 6), round(fps / n, 6), round(tps / p, 6) FROM c, tot""")
def q_metric_roc_points(spark, d):
    return r6(metrics.roc_points(fx.scored_lineitem(spark, d), "y", "score"))


@register("metric_roc_curve", _with(fx.SCORED_FINE_SQL, _SCORES) + """
, c AS (SELECT score, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
               row_number() OVER (ORDER BY score DESC) AS i FROM st
        WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, lag(tps) OVER o AS tp0, lead(tps) OVER o AS tp2, lag(fps) OVER o AS fp0, lead(fps) OVER o AS fp2
      FROM c WINDOW o AS (ORDER BY i)),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n, count(*) AS d FROM st)
SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT round(score, 6), round(fps / n, 6), round(tps / p, 6) FROM b, tot
WHERE i = 1 OR i = d OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0""")
def q_metric_roc_curve(spark, d):
    return r6(metrics.roc_points(fx.scored_fine(spark, d), "y", "score", drop_intermediate=True))


@register("metric_auc", _with(fx.SCORED_LINEITEM_SQL, _SCORES) + """
, c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below
        FROM st)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""")
def q_metric_auc(spark, d):
    return r6(metrics.auc(fx.scored_lineitem(spark, d), "y", "score"))


@register("fold_f1_table", _with(fx.SCORED_LINEITEM_SQL) + """
, cells AS (SELECT fold, label AS actual, prediction AS predicted, count(*) AS n FROM scored GROUP BY 1, 2, 3),
roles AS (SELECT fold, label, sum(s) AS support, sum(p) AS n_predicted, sum(tp) AS tp FROM (
            SELECT fold, actual AS label, n AS s, 0 AS p, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM cells
            UNION ALL SELECT fold, predicted, 0, n, 0 FROM cells) GROUP BY fold, label),
f AS (SELECT fold, label, CASE WHEN support + n_predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + n_predicted) END AS f1
      FROM roles)
SELECT fold, round(avg(f1), 6) AS macro_f1,
       round(coalesce(max(f1) FILTER (WHERE label = 'A'), 0.0), 6) AS F1_A,
       round(coalesce(max(f1) FILTER (WHERE label = 'N'), 0.0), 6) AS F1_N,
       round(coalesce(max(f1) FILTER (WHERE label = 'R'), 0.0), 6) AS F1_R
FROM f GROUP BY fold""")
def q_fold_f1_table(spark, d):
    s = fx.scored_lineitem(spark, d).withColumn("fold", F.col("fold").cast("int"))
    return r6(metrics.fold_f1_table(s, "label", "prediction", "fold"))


@register("fold_accuracy_summary", _with(fx.SCORED_LINEITEM_SQL) + """
, a AS (SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM scored GROUP BY fold)
SELECT round(avg(acc), 6) AS mean_accuracy, round(stddev_pop(acc), 6) AS std_accuracy FROM a""")
def q_fold_accuracy_summary(spark, d):
    return r6(metrics.fold_accuracy_summary(fx.scored_lineitem(spark, d)))


# ======================================================================================
# Importance-based selection (O1-O3) on a data-derived importance table
# ======================================================================================
_IMP_FEATURES = ["price", "month", "year", "priority"]


def _importance_table(spark, d) -> DataFrame:
    """|mean(x | y=1) - mean(x | y=0)| / std(x), normalised to sum 1 (one aggregation pass)."""
    o = fx.orders_learning(spark, d)
    aggs = []
    for c in _IMP_FEATURES:
        aggs += [F.avg(F.when(F.col("y") == 1, F.col(c))).alias(f"{c}_1"),
                 F.avg(F.when(F.col("y") == 0, F.col(c))).alias(f"{c}_0"),
                 F.stddev_pop(c).alias(f"{c}_s")]
    wide = o.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"),
        (F.abs(F.col(f"{c}_1") - F.col(f"{c}_0")) / F.col(f"{c}_s")).alias("raw")) for c in _IMP_FEATURES]))
        .alias("_e")).select("_e.*")
    from pyspark.sql import Window
    return long.select("feature", (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("importance"))


_IMP_SQL = "imp_raw AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(avg({c}) FILTER (WHERE y = 1) - avg({c}) FILTER (WHERE y = 0)) / stddev_pop({c}) AS raw "
    f"FROM ol" for c in _IMP_FEATURES) + """),
imp AS (SELECT feature, raw / sum(raw) OVER () AS importance FROM imp_raw)"""
_OL_SQL = """ol AS (
  SELECT o_orderkey, o_totalprice AS price, CAST(month(o_orderdate) AS DOUBLE) AS month,
         CAST(year(o_orderdate) AS DOUBLE) AS year, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
  FROM orders)"""


@register("importance_sorted", _with(_OL_SQL, _IMP_SQL) + "SELECT feature, round(importance, 6) AS importance FROM imp")
def q_importance_sorted(spark, d):
    from ..operators import select
    return r6(select.importance_sorted(_importance_table(spark, d)))


@register("importance_top_n", _with(_OL_SQL, _IMP_SQL)
          + "SELECT feature, round(importance, 6) AS importance FROM imp ORDER BY importance DESC, feature LIMIT 2")
def q_importance_top_n(spark, d):
    from ..operators import select
    return r6(select.importance_top_n(_importance_table(spark, d), 2))


@register("importance_threshold", _with(_OL_SQL, _IMP_SQL)
          + "SELECT feature, round(importance, 6) AS importance FROM imp WHERE importance > 0.2")
def q_importance_threshold(spark, d):
    from ..operators import select
    return r6(select.importance_threshold(_importance_table(spark, d), 0.2))


# ======================================================================================
# Nearest neighbours and resampling
# ======================================================================================
@register("knn_neighbors", _with(fx.ORDERS_POINTS_SQL) + """
SELECT label, qid, nid, round(d2, 6) AS d2, rank FROM (
  SELECT a.o_orderstatus AS label, a.o_orderkey AS qid, b.o_orderkey AS nid,
         (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2) AS d2,
         row_number() OVER (PARTITION BY a.o_orderkey ORDER BY
             (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2), b.o_orderkey) AS rank
  FROM pts a JOIN pts b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderkey <> b.o_orderkey)
WHERE rank <= 5""")
def q_knn_neighbors(spark, d):
    from ..operators.knn import knn
    out = knn(fx.orders_points(spark, d), "o_orderkey", ["f1", "f2"], 5, "o_orderstatus")
    return r6(out.select(F.col("group").alias("label"), "qid", "nid", "d2", F.col("rank").cast("long")))


_HEX = "CAST(('0x' || substr(h, {a}, {n})) AS BIGINT)"


@register("smote_oversample", _with(fx.ORDERS_POINTS_SQL) + """
, c AS (SELECT o_orderstatus, count(*) AS n FROM pts GROUP BY 1),
mx AS (SELECT max(n) AS m FROM c),
plan AS (SELECT o_orderstatus, n, m - n AS need, 5 AS kc,
                coalesce(sum(m - n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS start
         FROM c, mx WHERE m - n > 0),
hs AS (SELECT o_orderstatus, n, kc, start + i AS g,
              md5(concat_ws('|', '42', o_orderstatus, CAST(i AS VARCHAR))) AS h
       FROM (SELECT *, unnest(range(need)) AS i FROM plan)),
ch AS (SELECT o_orderstatus, g,
              """ + _HEX.format(a=1, n=15) + """ % n + 1 AS brn,
              """ + _HEX.format(a=16, n=8) + """ % kc + 1 AS nrank,
              CAST(""" + _HEX.format(a=24, n=8) + """ AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
       FROM hs),
mino AS (SELECT * FROM pts WHERE o_orderstatus IN (SELECT o_orderstatus FROM plan)),
num AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS brn FROM mino),
nn AS (SELECT * FROM (
         SELECT a.o_orderkey AS qid, b.o_orderkey AS nid,
                row_number() OVER (PARTITION BY a.o_orderkey ORDER BY
                    (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2), b.o_orderkey) AS nrank
         FROM mino a JOIN mino b ON a.o_orderstatus = b.o_orderstatus AND a.o_orderkey <> b.o_orderkey)
       WHERE nrank <= 5)
SELECT o_orderkey, o_orderstatus, f1, f2, false AS synthetic FROM pts
UNION ALL
SELECT -1 - ch.g, ch.o_orderstatus, b.f1 + ch.u * (x.f1 - b.f1), b.f2 + ch.u * (x.f2 - b.f2), true
FROM ch JOIN num b ON b.o_orderstatus = ch.o_orderstatus AND b.brn = ch.brn
JOIN nn ON nn.qid = b.o_orderkey AND nn.nrank = ch.nrank
JOIN pts x ON x.o_orderkey = nn.nid""")
def q_smote_oversample(spark, d):
    from ..operators.resample import smote
    # no rounding: both engines compute the same IEEE doubles here, and rounding would create ties
    return smote(fx.orders_points(spark, d), "o_orderkey", "o_orderstatus", ["f1", "f2"])


@register("enn_clean", _with(fx.ORDERS_POINTS_SQL) + """
, nn AS (SELECT a.o_orderkey AS qid,
                arg_min(b.o_orderstatus,
                        struct_pack(d := (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2),
                                    n := b.o_orderkey), 3) AS labs
         FROM pts a JOIN pts b ON a.o_orderkey <> b.o_orderkey GROUP BY a.o_orderkey)
SELECT p.o_orderkey, p.o_orderstatus, p.f1, p.f2 FROM pts p JOIN nn ON nn.qid = p.o_orderkey
WHERE list_bool_and(list_transform(labs, lambda l: l = p.o_orderstatus))""")
def q_enn_clean(spark, d):
    from ..operators.resample import enn
    return enn(fx.orders_points(spark, d), "o_orderkey", "o_orderstatus", ["f1", "f2"])


# ======================================================================================
# Learners, selection, validation, search, scoring (M1-M9) on a label that one feature decides:
# the right predictions, folds and reports are known, and DuckDB can state them
# ======================================================================================
_SEP_SPLIT_SQL = """r AS (SELECT o_orderkey, priority, {y} AS y, row_number() OVER (PARTITION BY {y}
                            ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rn FROM sep),
c AS (SELECT y, count(*) AS n FROM r GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS nt FROM c),
b AS (SELECT y, (n * nt) // total AS base, (n * nt) % total AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y)
                             <= (SELECT nt FROM t) - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
sp AS (SELECT o_orderkey, priority, y, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (y))"""
_SEP = _with(fx.ORDERS_SEPARABLE_SQL, _SEP_SPLIT_SQL.format(y="y"))
_SEP3 = _with(fx.ORDERS_SEPARABLE_SQL, _SEP_SPLIT_SQL.format(y="kind"))
_EXACT = _SEP + "SELECT o_orderkey, y, CAST(y AS DOUBLE) AS prediction, true AS sure FROM sp WHERE split = 'test'"
#: The search space of tune and pipeline_report: the operator's own but for the rounds, whose default upper bound is 1000.
#: Every other fit uses the learners' defaults (100 rounds).
_BOUNDS = {**DEFAULT_BOUNDS["xgb"], "n_estimators": (50, 150)}


def _learn_split(spark, d, label="y"):
    data = fx.orders_separable(spark, d).drop("kind" if label == "y" else "y")
    return split.train_test_split(data, label, ["o_orderkey"], 0.2, 42)


def _judged(scored: DataFrame) -> DataFrame:
    """Predictions, and whether the probability is one and agrees with the label."""
    sure = F.col("prob_1").between(0, 1) & (F.when(F.col("y") == 1, F.col("prob_1")).otherwise(1 - F.col("prob_1")) > 0.5)
    return scored.select("o_orderkey", "y", "prediction", sure.alias("sure"))


@register("train_gbt", _EXACT)
def q_train_gbt(spark, d):
    from ..operators import learn
    train, test = _learn_split(spark, d)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type="xgb", imputer_strategy="median",
                              exclude=["o_orderkey"])
    return _judged(learn.score(built, test, keep=["o_orderkey", "y"]))


@register("train_rf", _EXACT)
def q_train_rf(spark, d):
    from ..operators import learn
    train, test = _learn_split(spark, d)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type="rf", imputer_strategy="median",
                              scaler_type="robust", exclude=["o_orderkey"])
    return _judged(learn.score(built, test, keep=["o_orderkey", "y"]))


@register("train_text_labels", _SEP3 + """
SELECT o_orderkey, y AS kind, y AS prediction, true AS sure FROM sp WHERE split = 'test'""")
def q_train_text_labels(spark, d):
    """Three text classes: predictions are labels again, and every class has a probability."""
    from ..operators import learn
    train, test = _learn_split(spark, d, "kind")
    built = learn.build_model(train, "kind", fx.LEARN_FEATURES, model_type="xgb", imputer_strategy="median",
                              exclude=["o_orderkey"])
    out = learn.score(built, test, keep=["o_orderkey", "kind"])
    probs = [F.col(f"prob_{v}") for v in built.labels]
    own = F.element_at(F.create_map(*[x for v in built.labels for x in (F.lit(v), F.col(f"prob_{v}"))]), F.col("kind"))
    return out.select("o_orderkey", "kind", "prediction", ((own == F.greatest(*probs)) & (F.abs(sum(probs) - 1) < 1e-9)).alias("sure"))


@register("feature_importance", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {1.0 if c == 'priority' else 0.0}::DOUBLE)" for c in fx.LEARN_FEATURES) + ") AS t(feature, importance)")
def q_feature_importance(spark, d):
    from ..operators import learn, select
    train, _ = _learn_split(spark, d)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type="xgb", exclude=["o_orderkey"])
    return r6(select.importance_sorted(learn.feature_importance(built)))


@register("select_features", _SEP + "SELECT split, CAST(priority AS DOUBLE) AS priority, y FROM sp")
def q_select_features(spark, d):
    from ..operators import select
    train, test = _learn_split(spark, d)
    _, chosen, train_sel, test_sel, _ = select.select_features(train, "y", fx.LEARN_FEATURES, "xgb", top_n=1, test=test)
    return train_sel.withColumn("split", F.lit("train")).unionByName(test_sel.withColumn("split", F.lit("test"))).select("split", *chosen, "y")


@register("build_model", _EXACT)
def q_build_model(spark, d):
    from ..operators import learn
    train, test = _learn_split(spark, d)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type="xgb", imputer_strategy="median",
                              scaler_type="robust", resample_type="smoteenn", id_col="o_orderkey")
    return _judged(learn.score(built, test, keep=["o_orderkey", "y"]))


@register("cv_fold_f1", "SELECT unnest(range(1, 11))::INTEGER AS fold, 1.0::DOUBLE AS macro_f1, 1.0::DOUBLE AS F1_0, 1.0::DOUBLE AS F1_1")
def q_cv_fold_f1(spark, d):
    from ..operators import search
    data = fx.orders_separable(spark, d).drop("kind")
    return r6(search.cross_validate(data, "y", ["o_orderkey"], fx.LEARN_FEATURES, "xgb", None, "robust", "median"))


def _uniform_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


def _in_bounds_sql(name: str, x: str) -> str:
    lo, hi = (float(v) for v in _BOUNDS[name])
    v = f"({lo}::DOUBLE + {x} * ({hi}::DOUBLE - {lo}::DOUBLE))"
    return v if name == "learning_rate" else f"CAST(floor({v}) AS BIGINT)"


def _tune_sql() -> str:
    """Two uniform trials, both of score 1 (the first is the good quarter), and two proposals by the density ratio of one point each."""
    names = sorted(_BOUNDS)
    columns = ", ".join(names)
    near = lambda x, p: f"(1 + exp(-0.5::DOUBLE * (({x} - {p}) / 0.25::DOUBLE) ** 2) / (0.25::DOUBLE * sqrt(2 * pi()))) / 2"
    place = lambda n, t: f"(SELECT ({n} - {float(_BOUNDS[n][0])}::DOUBLE) / ({float(_BOUNDS[n][1])}::DOUBLE - {float(_BOUNDS[n][0])}::DOUBLE) FROM init WHERE trial = {t})"
    key = lambda n, what: _uniform_sql("'42'", "trial", "d", f"'{n}'", f"'{what}'")
    drawn = ", ".join(
        f"""CASE WHEN floor({key(n, 'kernel')} * 2) = 1 THEN {key(n, 'place')} ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, g_{n}
            + sqrt(-2 * ln(1 - {key(n, 'place')})) * cos(2 * pi() * {key(n, 'turn')}) * 0.25::DOUBLE)) END AS {n}""" for n in names)
    return f"""
WITH init AS (SELECT trial, {", ".join(f"{_in_bounds_sql(n, _uniform_sql("'42'", 'trial', f"'{n}'"))} AS {n}" for n in names)} FROM range(2) AS t(trial)),
p AS (SELECT {", ".join(f"{place(n, 0)} AS g_{n}, {place(n, 1)} AS b_{n}" for n in names)}),
x AS (SELECT trial, d, {drawn}, {", ".join(f"g_{n}, b_{n}" for n in names)} FROM range(2, 4) AS t(trial), range({DRAWS}) AS r(d), p),
r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY {" + ".join(f"(ln({near(n, f'g_{n}')}) - ln({near(n, f'b_{n}')}))" for n in names)} DESC, d) AS place FROM x)
SELECT trial, {", ".join(f"round({n}, 6) AS {n}" if n == "learning_rate" else n for n in names)}, 1.0::DOUBLE AS mean_macro_f1 FROM (
  SELECT trial, {columns} FROM init UNION ALL SELECT trial, {", ".join(f"{_in_bounds_sql(n, n)} AS {n}" for n in names)} FROM r WHERE place = 1)"""


@register("tune", _tune_sql())
def q_tune(spark, d):
    """Two uniform trials and two that their scores propose, over five folds; bounds as the operator's, with 50 to 150 rounds."""
    from ..operators import search
    data = fx.orders_separable(spark, d).drop("kind")
    _, trials = search.tune(data, "y", ["o_orderkey"], fx.LEARN_FEATURES, "xgb", None, "robust", "median",
                            init_points=2, n_iter=2, bounds=_BOUNDS)
    return r6(trials)


@register("score_batch", _with(fx.ORDERS_SEPARABLE_SQL) + "SELECT o_orderkey, CAST(y AS DOUBLE) AS prediction, true AS sure FROM sep")
def q_score_batch(spark, d):
    from ..operators import learn
    data = fx.orders_separable(spark, d).drop("kind")
    train, _ = _learn_split(spark, d)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type="xgb", imputer_strategy="median", exclude=["o_orderkey"])
    out = learn.score(built, data.drop("y"), keep=["o_orderkey"])
    return out.select("o_orderkey", "prediction", ((F.col("prediction") == 1) == (F.col("prob_1") > 0.5)).alias("sure"))


@register("stored_model", """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'new' ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 13 = 0 THEN -1.0::DOUBLE ELSE CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1 END AS code,
       CASE WHEN o_orderkey % 13 = 0 OR substr(o_orderpriority, 1, 1) <= '2' THEN 'urgent' ELSE 'normal' END AS prediction FROM orders""")
def q_stored_model(spark, d):
    """T1-T9, M6, K5, S5, M9 as one object: fitted on raw categories, saved, loaded anew, and scoring raw rows of which every 13th has an unseen category."""
    from pyspark.ml import Pipeline, PipelineModel

    from ..operators.estimators import OrdinalEncoder, TabularClassifier
    from ..sources.paths import delete_path
    orders = fx.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").cast("double").alias("month"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    folder = _folder(spark)
    train = orders.withColumn("kind", F.when(F.substring("priority", 1, 1) <= "2", "urgent").otherwise("normal"))
    Pipeline(stages=[OrdinalEncoder(inputCols=["priority"]),
                     TabularClassifier(labelCol="kind", featureCols=["priority", "month", "price"], imputerStrategy="median", scaler="robust")]
             ).fit(train).write().overwrite().save(folder)
    raw = orders.withColumn("priority", F.when(F.col("o_orderkey") % 13 == 0, "new").otherwise(F.col("priority")))
    loaded = PipelineModel.load(folder)
    out = cut_lineage(loaded.transform(raw.withColumn("raw", F.col("priority"))).select(
        "o_orderkey", F.col("raw").alias("priority"), F.col("priority").alias("code"), "prediction"))
    delete_path(spark, folder)
    return out


# -- the same learners on a label that the features do not decide: what must hold all the same ------
_NOISY_SQL = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
n AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rn FROM r),
c AS (SELECT y, count(*) AS n FROM r GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS nt FROM c),
b AS (SELECT y, (n * nt) // total AS base, (n * nt) % total AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT nt FROM t) - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b)
SELECT o_orderkey, y, true AS valid FROM n JOIN q USING (y) WHERE rn <= quota"""


def _noisy(spark, d, algo: str, params: dict) -> DataFrame:
    from ..operators import learn
    train, test = split.train_test_split(fx.orders_learning(spark, d), "y", ["o_orderkey"], 0.2, 42)
    built = learn.build_model(train, "y", fx.LEARN_FEATURES, model_type=algo, model_params=params, exclude=["o_orderkey"])
    out = learn.score(built, test, keep=["o_orderkey", "y"])
    valid = F.col("prob_1").between(0, 1) & (F.col("prediction") == F.when(F.col("prob_1") > 0.5, 1.0).otherwise(0.0))
    return out.select("o_orderkey", "y", valid.alias("valid"))


@register("train_gbt_noisy", _NOISY_SQL)
def q_train_gbt_noisy(spark, d):
    return _noisy(spark, d, "xgb", {})


@register("train_rf_noisy", _NOISY_SQL)
def q_train_rf_noisy(spark, d):
    return _noisy(spark, d, "rf", {"max_depth": 10})


@register("cv_fold_f1_noisy", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
n AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rn FROM r),
f AS (SELECT y, (rn - 1 + CASE WHEN y = 1 THEN (SELECT count(*) FROM r WHERE y = 0) ELSE 0 END) % 10 + 1 AS fold FROM n)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_1, true AS valid FROM f GROUP BY fold""")
def q_cv_fold_f1_noisy(spark, d):
    """Ten folds of the right sizes, each with F1 in [0, 1] whose mean is the macro F1."""
    from ..operators import search
    data = fx.orders_learning(spark, d)
    scores = search.cross_validate(data, "y", ["o_orderkey"], fx.LEARN_FEATURES, "xgb", None, "robust", "median")
    sizes = split.stratified_folds(data, "y", ["o_orderkey"], 10, 42).groupBy((F.col("fold") + 1).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("n_1"))
    valid = F.col("F1_0").between(0, 1) & F.col("F1_1").between(0, 1) & (
        F.abs(F.col("macro_f1") - (F.col("F1_0") + F.col("F1_1")) / 2) < 1e-9)
    return scores.join(sizes, "fold").select("fold", "n", "n_1", valid.alias("valid"))


# ======================================================================================
# Sources and sinks (S1, S2, S4, K1, K8): round trips through the shared folder
# ======================================================================================
def _folder(spark) -> str:
    import uuid

    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/trip-{uuid.uuid4().hex}"


def _kept(result: DataFrame, folder: str) -> DataFrame:
    """The result as a checkpoint; the folder it was read from goes."""
    from ..sources.paths import delete_path
    out = cut_lineage(result)
    delete_path(result.sparkSession, folder)
    return out


@register("read_csv_profile", ORACLES["eda_missing"])
def q_read_csv_profile(spark, d):
    """K1 writes the table as CSV (a written table in the shared checkpoint folder),
    S1 reads it back with a header and inferred types, then A1 profiles it."""
    from ..sources import read_table, write_table
    folder = _folder(spark)
    write_table(fx.orders_nulls(spark, d), f"{folder}/orders_n.csv")
    return _kept(profile.missing_counts(read_table(spark, f"{folder}/orders_n.csv")), folder)


@register("read_csv_text", """
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'say "' || text || '", "",' || chr(10) ELSE text END AS text FROM documents""")
def q_read_csv_text(spark, d):
    """Whole texts with quotes, commas, line breaks, empty and missing ones through K1 and S1."""
    from ..sources import read_table, write_table
    k, t = F.col("doc_id") % 10, F.col("text")
    text = F.when(k == 0, "").when(k == 1, F.lit(None)).when(k == 2, F.concat(F.lit('say "'), t, F.lit('", "",\n'))).otherwise(t)
    folder = _folder(spark)
    write_table(fx.table(spark, d, "documents").select("doc_id", text.alias("text")), f"{folder}/t.csv")
    return _kept(read_table(spark, f"{folder}/t.csv", "doc_id LONG, text STRING", multi_line=True), folder)


_DAMAGED_SQL = """lines AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority AS p, CASE o_orderkey % 10
    WHEN 1 THEN 'x' || o_orderkey || ',' || o_custkey || ',' || o_orderpriority
    WHEN 2 THEN o_orderkey || ',' || o_custkey
    WHEN 3 THEN o_orderkey || ',' || o_custkey || ',' || o_orderpriority || ',more'
    WHEN 4 THEN o_orderkey || ',1e,' || o_orderpriority
    WHEN 5 THEN o_orderkey || ',,' || o_orderpriority
    ELSE o_orderkey || ',' || o_custkey || ',' || o_orderpriority END AS line FROM orders)"""


@register("read_csv_rejects", "WITH " + _DAMAGED_SQL + """
SELECT k AS o_orderkey, CASE WHEN k % 10 = 5 THEN NULL ELSE CAST(c AS BIGINT) END AS o_custkey, p AS o_orderpriority, NULL AS record, NULL AS reason FROM lines WHERE k % 10 NOT IN (1, 2, 3, 4)
UNION ALL SELECT NULL, NULL, NULL, line, CASE k % 10 WHEN 1 THEN 'o_orderkey' WHEN 4 THEN 'o_custkey' ELSE 'fields' END FROM lines WHERE k % 10 IN (1, 2, 3, 4)""")
def q_read_csv_rejects(spark, d):
    """S1 on a damaged file: a wrong number of fields, text in a number, an empty field (which is no damage); good rows and rejected records."""
    from ..sources import read_checked
    k, c, p = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    damage = {1: [F.concat(F.lit("x"), k), c, p], 2: [k, c], 3: [k, c, p, F.lit("more")], 4: [k, F.lit("1e"), p], 5: [k, F.lit(""), p]}
    line = F.concat_ws(",", k, c, p)
    for at, parts in damage.items():
        line = F.when(F.col("o_orderkey") % 10 == at, F.concat_ws(",", *parts)).otherwise(line)
    folder = _folder(spark)
    fx.table(spark, d, "orders").select(line.alias("value")).write.text(f"{folder}/lines.csv")
    read = read_checked(spark, f"{folder}/lines.csv", "o_orderkey LONG, o_custkey LONG, o_orderpriority STRING", header=False)
    good = read.rows.withColumns({"record": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return _kept(good.unionByName(read.rejects.select("record", "reason"), allowMissingColumns=True), folder)


@register("load_split_roundtrip", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS side,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 6) END AS price FROM orders""")
def q_load_split_roundtrip(spark, d):
    """A stored dataset with NaN comes back in two parts, with NULL."""
    from ..sources import load_split
    folder, k = _folder(spark), F.col("o_orderkey")
    fx.table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 5 == 0, "test").otherwise("train").alias("split")).write.partitionBy("split").parquet(f"{folder}/ds")
    train, test = load_split(spark, f"{folder}/ds")
    return _kept(r6(train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))), folder)


@register("cache_append_roundtrip", _with(fx.ORDER_POINTS_SQL, fx.CUSTOMER_CACHE_SQL) + """
SELECT o_orderkey, location AS cached_location FROM pts_o
LEFT JOIN cache_c ON round(latitude, 4) = lat_key AND round(longitude, 4) = lon_key""")
def q_cache_append_roundtrip(spark, d):
    """K8 twice with overlapping keys, then J1: one row per key, one row per order."""
    from ..sources import append_cache, load_cache
    folder = _folder(spark)
    entries = fx.customer_cache(spark, d)
    append_cache(entries.where("lon_key < 15"), f"{folder}/cache.parquet")
    append_cache(entries, f"{folder}/cache.parquet")
    found = locate.lookup(fx.order_points(spark, d), load_cache(spark, f"{folder}/cache.parquet"))
    return _kept(found.select("o_orderkey", "cached_location"), folder)


@register("cache_table_lookup", _with(fx.ORDER_POINTS_SQL, fx.CUSTOMER_CACHE_SQL) + """
SELECT o_orderkey, location AS cached_location, CASE WHEN lon_key < 15 THEN 'first' WHEN lon_key IS NOT NULL THEN 'second' END AS batch FROM pts_o
LEFT JOIN cache_c ON round(latitude, 4) = lat_key AND round(longitude, 4) = lon_key""")
def q_cache_table_lookup(spark, d):
    """K8 into a bucketed table: two overlapping batches, the first once more, and the table opened anew; then J1, with the batch that wrote each key."""
    from ..sources import CacheTable, whole_keys
    folder = _folder(spark)
    entries = fx.customer_cache(spark, d)
    for batch, rows in (("first", entries.where("lon_key < 15")), ("second", entries), ("first", entries)):
        cache = CacheTable(spark, folder, buckets=16)
        cache.append(rows, batch)
        cache.forget()
    cache = CacheTable(spark, folder)
    found = whole_keys(locate.lookup_stored(fx.order_points(spark, d), cache))
    written = cache.entries().groupBy("lat_e4", "lon_e4").agg(F.concat_ws("+", F.collect_list("batch")).alias("batch"))
    out = _kept(found.join(written, ["lat_e4", "lon_e4"], "left").select("o_orderkey", "cached_location", "batch"), folder)
    cache.forget()
    return out


@register("fold_accuracy", _with(fx.SCORED_LINEITEM_SQL) + """
SELECT fold, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY fold""")
def q_fold_accuracy(spark, d):
    return r6(metrics.fold_accuracy(fx.scored_lineitem(spark, d)))


# ======================================================================================
# The whole workflow (the reference's end-to-end order) on orders x customer
# ======================================================================================
@register("pipeline_report", """
WITH l AS (SELECT CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 1 ELSE 0 END AS y FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT y, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS nt FROM c),
b AS (SELECT y, (n * nt) // total AS base, (n * nt) % total AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT nt FROM t) - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b)
SELECT CAST(y AS VARCHAR) AS label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, CAST(quota AS BIGINT) AS support FROM q
UNION ALL SELECT 'accuracy', NULL, NULL, 1.0, nt FROM t
UNION ALL SELECT unnest(['macro avg', 'weighted avg']), 1.0, 1.0, 1.0, nt FROM t""")
def q_pipeline_report(spark, d):
    """Every stage of the workflow; the search of 2 + 2 trials x 5 folds has the operator's bounds, with 50 to 150 rounds."""
    from .pipeline import PipelineConfig, run_pipeline
    o, c = fx.table(spark, d, "orders"), fx.table(spark, d, "customer")
    data = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey",
        F.concat_ws(", ", "c_mktsegment", "o_orderpriority").alias("sources"),
        (F.col("c_acctbal") / 130.0).alias("latitude"),
        (F.col("c_nationkey").cast("double") * 1.5).alias("longitude"),
        "c_mktsegment",
        F.col("o_totalprice").alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.lit("unused").alias("comment"),
        (F.substring("o_orderpriority", 1, 1) <= "2").cast("int").alias("y"))
    cfg = PipelineConfig(label_col="y", id_cols=["o_orderkey"], drop_cols=["comment"], sources_col="sources",
                         lat_col="latitude", lon_col="longitude", encode_cols=["c_mktsegment", "location"],
                         tune_trials=(2, 2), cv_splits=5, validation_splits=10, tune_bounds=_BOUNDS)
    return r6(run_pipeline(data, cfg, fx.location_cache(spark, d)).report)
