"""Grouped counts, distinct counts, class distributions, means and arg-best
(A1-A6, A10). Every aggregate is partial + final (map-side combine), so hot
keys are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_list(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def count_per_key(df: DataFrame, keys, count_col: str = "count") -> DataFrame:
    """A1/A2: rows per key (or key tuple)."""
    return df.groupBy(*_as_list(keys)).agg(F.count(F.lit(1)).alias(count_col))


def row_count(df: DataFrame, count_col: str = "count") -> DataFrame:
    """A4: global row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(count_col))


def distinct_count_per_group(df: DataFrame, group_cols, value_col: str,
                             count_col: str = "n_distinct", count_null: bool = True) -> DataFrame:
    """A3: distinct ``value_col`` values per group.

    ``count_null=True`` counts a NULL value as one more distinct value, which
    is what distinct-then-count gives; ``False`` is SQL ``COUNT(DISTINCT)``.
    """
    n = F.count_distinct(value_col)
    if count_null:
        n = n + F.max(F.col(value_col).isNull().cast("int"))
    return df.groupBy(*_as_list(group_cols)).agg(n.cast("bigint").alias(count_col))


def class_distribution(df: DataFrame, label_col: str, part_col: str | None = None,
                       count_col: str = "count") -> DataFrame:
    """A5: rows per class, optionally per split part, in one pass."""
    keys = [part_col, label_col] if part_col else [label_col]
    return count_per_key(df, keys, count_col)


def mean_per_group(df: DataFrame, group_cols, value_col: str, out_col: str | None = None) -> DataFrame:
    """Mean of ``value_col`` per group."""
    return df.groupBy(*_as_list(group_cols)).agg(F.avg(value_col).alias(out_col or f"avg_{value_col}"))


def arg_best(df: DataFrame, metric_col: str, position_col: str, maximize: bool,
             group_cols=None, payload_cols=None) -> DataFrame:
    """A10: the row with the best metric, first position on ties, per group.

    ``min`` over ``struct(metric, position)`` picks the smallest metric and, on
    ties, the smallest position; for a maximum the metric is negated. One
    aggregate, no sort.
    """
    group_cols = [] if group_cols is None else _as_list(group_cols)
    payload_cols = [] if payload_cols is None else _as_list(payload_cols)
    key = -F.col(metric_col) if maximize else F.col(metric_col)
    best = F.min(F.struct(key.alias("_k"), F.col(position_col).alias("_p"),
                          *[F.col(c) for c in payload_cols], F.col(metric_col).alias("_m")))
    agg = df.groupBy(*group_cols).agg(best.alias("_best"))
    return agg.select(*group_cols, F.col("_best._p").alias(position_col),
                      *[F.col(f"_best.{c}").alias(c) for c in payload_cols],
                      F.col("_best._m").alias(metric_col))
