"""Dense count grids, per-fold summaries and 2-D metric matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def dense_grid(counts: DataFrame, group_cols, x_col: str, x_values: range, y_col: str,
               y_values: range, count_col: str = "count", groups: DataFrame | None = None) -> DataFrame:
    """Every (x, y) cell for every group, missing cells 0.

    ``counts`` holds (group..., x, y, count) for observed cells; cells outside
    the ranges or with NULL coordinates are not part of the grid. Cells are
    generated per group by exploding a fixed-length sequence (len(x) x len(y)
    rows per group), then left-joined to the observed counts: no cross join,
    and the output size is bounded by groups x cells.
    """
    group_cols = _as_list(group_cols)
    nx, ny = len(x_values), len(y_values)
    if groups is None:
        groups = counts.select(*group_cols).distinct()
    cell = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("_cell")
    cells = groups.select(*group_cols, cell).select(
        *group_cols,
        (F.lit(x_values.start) + (F.col("_cell") / F.lit(ny)).cast("int") * F.lit(x_values.step)).cast("int").alias(x_col),
        (F.lit(y_values.start) + (F.col("_cell") % F.lit(ny)) * F.lit(y_values.step)).cast("int").alias(y_col),
    )
    observed = counts.select(*group_cols, F.col(x_col).cast("int").alias(x_col),
                             F.col(y_col).cast("int").alias(y_col), count_col)
    return (cells.join(observed, [*group_cols, x_col, y_col], "left")
                 .select(*group_cols, x_col, y_col,
                         F.coalesce(F.col(count_col), F.lit(0)).cast("bigint").alias(count_col)))


def fold_summary(metrics: DataFrame, group_cols, fold_col: str, value_col: str,
                 folds: Sequence[int], prefix: str | None = None) -> DataFrame:
    """One row per group with one column per fold, the mean and the population std, in one aggregate."""
    prefix = prefix or value_col
    return metrics.groupBy(*_as_list(group_cols)).agg(
        *[F.max(F.when(F.col(fold_col) == f, F.col(value_col))).alias(f"{prefix}_fold{f}") for f in folds],
        F.avg(value_col).alias(f"{prefix}_mean"), F.stddev_pop(value_col).alias(f"{prefix}_std"))


def metric_matrix(metrics: DataFrame, row_param: str, col_param: str, value_col: str,
                  col_values: Sequence) -> DataFrame:
    """``row_param`` x ``col_param`` matrix of a metric (long table -> pivot)."""
    out = metrics.groupBy(row_param).pivot(col_param, list(col_values)).agg(F.first(value_col))
    for v in col_values:
        out = out.withColumnRenamed(str(v), f"{col_param}_{v}")
    return out
