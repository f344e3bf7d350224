"""Sources and sinks: table readers, stand-in inputs, result tables."""

from quarry.sources.tables import (
    TABLES, append_results, positional_schema, read_csv, read_headerless_csv,
    read_log_text, read_results, read_table, split_features_label,
)
from quarry.sources import standins

__all__ = [
    "TABLES", "append_results", "positional_schema", "read_csv", "read_headerless_csv",
    "read_log_text", "read_results", "read_table", "split_features_label", "standins",
]
