from .cache_table import CacheTable, whole_keys
from .readers import (Checked, empty_cache, import_json_cache, load_cache, load_model, load_params, load_split,
                      nan_to_null, one_per_key, read_checked, read_table)
from .writers import (append_cache, save_model, save_params, write_encoded, write_mapping, write_report,
                      write_report_text, write_table)

__all__ = [
    "CacheTable", "Checked", "append_cache", "empty_cache", "import_json_cache", "load_cache", "load_model", "load_params", "load_split",
    "nan_to_null", "one_per_key", "read_checked", "read_table", "save_model", "save_params", "whole_keys", "write_encoded", "write_mapping", "write_report", "write_report_text",
    "write_table",
]
