"""Scalar column expressions (F1-F5, P4, P12). All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference behaviour.
# Coordinates are keyed by rounding to this many decimals (about an 11 m cell).
GEO_PRECISION = 4
# Missing strings become this literal when string columns are stringified.
NAN_TEXT = "nan"
# Location rule: first non-empty of these response fields, else this fallback.
LOCATION_FIELDS = ("country", "body_of_water")
UNKNOWN_LOCATION = "Unknown"
# Whitespace stripped around list items: the characters Python's str.strip()
# removes, as a regex class both Java regex and RE2 accept.
WS_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
TRIM_PATTERN = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading / trailing whitespace (the same characters as Python's strip())."""
    return F.regexp_replace(_col(c), TRIM_PATTERN, "")


def source_items(c) -> Column:
    """The non-empty, trimmed items of a comma list (outer single quotes removed)."""
    body = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^'+|'+$", "")
    items = F.transform(F.split(body, ","), lambda e: strip_ws(e))
    return F.filter(items, lambda e: e != F.lit(""))


def count_sources_expr(c) -> Column:
    """number of non-empty items of a comma list; NULL counts as 0."""
    return F.size(source_items(c)).cast("long")


def count_sources_scoring_expr(c) -> Column:
    """as F1 but blank / NULL text is missing (NULL), and quotes are kept."""
    items = F.filter(F.transform(F.split(_col(c), ","), lambda e: strip_ws(e)), lambda e: e != F.lit(""))
    return F.when(F.coalesce(strip_ws(c), F.lit("")) == F.lit(""), F.lit(None).cast("long")).otherwise(
        F.size(items).cast("long"))


def geo_key(c, precision: int = GEO_PRECISION) -> Column:
    """coordinate key = value rounded (half-up on the decimal form)."""
    return F.round(_col(c).cast("double"), precision)


def first_non_empty(*cols) -> Column:
    """first argument that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def int_param(c) -> Column:
    """integer hyperparameters are truncated toward zero."""
    return F.when(_col(c) >= 0, F.floor(_col(c))).otherwise(F.ceil(_col(c))).cast("long")


def stringify(c) -> Column:
    """Cast to string, missing becomes the literal 'nan'."""
    return F.coalesce(_col(c).cast("string"), F.lit(NAN_TEXT))


def safe_float(c) -> Column:
    """Parse text as double, unparsable text and NaN become NULL."""
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def hash_uniform(*parts, start: int = 0, width: int = 8) -> Column:
    """A deterministic number in [0, 1) from md5 of the '|'-joined parts.

    ``start``/``width`` choose which hex digits are used, so different draws
    for the same row can come from different substrings of the same hash.
    """
    h = F.md5(F.concat_ws("|", *[F.lit(p) if not isinstance(p, (Column, str)) else _col(p) for p in parts]))
    n = F.conv(F.substring(h, start + 1, width), 16, 10).cast("long")
    return n.cast("double") / F.lit(float(16 ** width))


def hash_int(*parts, start: int = 0, width: int = 8) -> Column:
    """Non-negative integer from md5 hex digits (same recipe as ``hash_uniform``)."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if not isinstance(p, (Column, str)) else _col(p) for p in parts]))
    return F.conv(F.substring(h, start + 1, width), 16, 10).cast("long")
