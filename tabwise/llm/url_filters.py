"""URL filters (native): hashed host-suffix / path-prefix expressions against a rule list.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a
rule could have, the expressions are hashed with SHA-256, joined with the
hashed rules on the first 4 bytes of the digest, and a hit counts only if the
full digest agrees. Of the rules that fit, the longest wins.

Only DataFrame functions are used. The URLs are reduced to distinct
(host, path) pairs first, so a URL that fills a third of the rows is expanded
once. The expansion is limited to the label counts and path lengths that occur
in the rules; both are bounded (``MAX_LABELS``, ``MAX_PATH``, longer rules are an
error), so what the driver sees does not grow with pages or rules.

Defined results: null URL, or one without ``://``: host and path empty, no
rule, the default verdict. Rules with a null or empty host, a null path or a
null verdict fit nothing. Several rules of equal length: the longer host wins,
then ``block``. Repeated rows and null ids stay as they are; other columns of
the input are kept; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import lower_ascii, table

MAX_LABELS, MAX_PATH = 127, 2048

#: Rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small rule list as a table (host, path, verdict)."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    named = {f"r{i}_{j}": x for i, rule in enumerate(rules) for j, x in enumerate(rule)}
    rows = ", ".join(f"(:r{i}_0, :r{i}_1, :r{i}_2)" for i in range(len(rules)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)", args=named)


def split_url(url):
    """(host, path) columns of a URL column."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _labels(host):
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    rules = (rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
             .filter("r_host <> '' AND r_path IS NOT NULL AND r_verdict IS NOT NULL"))
    shape = rules.agg(F.collect_set(F.least(_labels(F.col("r_host")), F.lit(MAX_LABELS + 1))),
                      F.collect_set(F.least(F.length("r_path"), F.lit(MAX_PATH + 1)))).first()
    if max(shape[0], default=0) > MAX_LABELS or max(shape[1], default=0) > MAX_PATH:
        raise ValueError(f"a rule has over {MAX_LABELS} host labels or a path over {MAX_PATH} characters")

    host, path = split_url(F.col(url))
    pages = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    suffixes = F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sorted(shape[0])])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape[1])])
    expressions = F.flatten(F.transform(F.array_compact(suffixes.cast("array<string>")), lambda h: F.transform(
        F.array_compact(prefixes.cast("array<string>")), lambda p: F.concat(h, p))))
    asked = (pages.select("host", "path").filter("host <> ''").distinct()
             .select("host", "path", F.explode(expressions).alias("expression"))
             .withColumn("digest", F.sha2("expression", 256)).drop("expression")
             .withColumn("short", F.substring("digest", 1, 8)))
    rule = F.concat("r_host", "r_path")
    listed = (rules.withColumn("r_rule", rule).withColumn("r_digest", F.sha2(rule, 256))
              .withColumn("short", F.substring("r_digest", 1, 8)))
    precedence = F.struct(F.length("r_rule"), F.length("r_host"), F.when(F.col("r_verdict") == "block", 1).otherwise(0), "r_verdict")
    best = (asked.join(listed, "short").filter("digest = r_digest")
            .groupBy("host", "path").agg(F.max_by(F.struct("r_rule", "r_verdict"), precedence).alias("__hit")))
    return (pages.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("__hit.r_rule"), "verdict": F.coalesce("__hit.r_verdict", F.lit(default))}).drop("__hit"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
h AS (SELECT host, path, arg_max({'r': rh || rp, 'v': v}, length(rh || rp)) AS b
      FROM (SELECT DISTINCT host, path FROM p) d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, h.b.r AS rule, coalesce(h.b.v, 'allow') AS verdict FROM p LEFT JOIN h ON p.host = h.host AND p.path = h.path
"""
