"""Previews and bounded collection.

Results stay DataFrames; these are the only two ways the library hands rows
to the driver, and both are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows as a DataFrame (a limit, not an action)."""
    return df.limit(n)


def collect_small(df: DataFrame, max_rows: int) -> list[Row]:
    """Collect a result that is small by construction.

    Fetches at most ``max_rows + 1`` rows and raises if there are more, so an
    unexpectedly large result fails loudly instead of being silently cut or
    flooding the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; keep it as a DataFrame")
    return rows
