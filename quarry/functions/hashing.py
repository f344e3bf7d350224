"""Deterministic hash buckets.

``rand(seed)`` and ``sampleBy`` depend on how the input is partitioned; a
bucket computed from the row key does not, and the same expression exists in
DuckDB: ``('0x' || substr(md5(key::VARCHAR), 1, 7))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 28  # seven hex digits


def key_text(*cols: Column | str, salt: str | None = None) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    return parts[0] if len(parts) == 1 else F.concat_ws("#", *parts)


def hash28(*cols: Column | str, salt: str | None = None) -> Column:
    """A 28-bit non-negative integer from md5 of the key text."""
    return F.conv(F.substring(F.md5(key_text(*cols, salt=salt)), 1, 7), 16, 10).cast("bigint")


def hash_bucket(*cols: Column | str, buckets: int, salt: str | None = None) -> Column:
    """Bucket in ``[0, buckets)``; same key, same bucket, on every partitioning."""
    return (hash28(*cols, salt=salt) % F.lit(buckets)).cast("int")


def unit_interval(*cols: Column | str, salt: str | None = None) -> Column:
    """A deterministic pseudo-uniform value in [0, 1) for fraction-based sampling."""
    return hash28(*cols, salt=salt).cast("double") / F.lit(float(HASH_SPACE))
