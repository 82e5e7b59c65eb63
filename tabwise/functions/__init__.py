from .exprs import (GEO_PRECISION, LOCATION_FIELDS, NAN_TEXT, UNKNOWN_LOCATION, count_sources_expr,
                    count_sources_scoring_expr, first_non_empty, geo_key, hash_int, hash_uniform, int_param,
                    safe_float, source_items, stringify, strip_ws)

__all__ = [
    "GEO_PRECISION", "LOCATION_FIELDS", "NAN_TEXT", "UNKNOWN_LOCATION", "count_sources_expr",
    "count_sources_scoring_expr", "first_non_empty", "geo_key", "hash_int", "hash_uniform", "int_param",
    "safe_float", "source_items", "stringify", "strip_ws",
]
