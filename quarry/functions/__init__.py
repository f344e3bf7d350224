"""Column expressions: every function returns a ``Column`` evaluated JVM-side."""

from quarry.functions.classify import ACADEMIC_SUFFIXES, organisation, suffix_class
from quarry.functions.hashing import hash28, hash_bucket, unit_interval
from quarry.functions.logparse import LOG_COLUMNS, parse_log
from quarry.functions.recode import binary_recode, percent, round_metric, sign_to_binary

__all__ = [
    "ACADEMIC_SUFFIXES", "organisation", "suffix_class", "hash28", "hash_bucket",
    "unit_interval", "LOG_COLUMNS", "parse_log", "binary_recode", "percent",
    "round_metric", "sign_to_binary",
]
