"""Access-log line parsing (F1-F7) as JVM-side column expressions.

Spark 4 runs with ANSI semantics: a plain ``cast`` of ``-`` to int, or
``element_at`` past the end of an array, raises. The parser therefore uses
``try_element_at`` and ``try_cast`` so malformed lines yield NULL fields
instead of failing the job, and a failed ``regexp_extract`` yields ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The field patterns of a common-log-format line.
HOST_PATTERN = r"^(.*) - -.*"
TIMESTAMP_PATTERN = r".* - - \[(.*?)\].*"
REQUEST_PATTERN = r'.*"(.*)".*'
DAY_PATTERN = r"(\d+)/\w+/\d+"
HOUR_PATTERN = r"\d+/\w+/\d+:(\d+):"
TIMESTAMP_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

LOG_COLUMNS = ["host", "timestamp", "request", "reply_code", "reply_bytes", "day", "hour"]


def host(value: Column) -> Column:
    """everything before the first `` - -`` (greedy, so the last one)."""
    return F.regexp_extract(value, HOST_PATTERN, 1)


def timestamp_text(value: Column) -> Column:
    """the bracketed timestamp text, kept as a string."""
    return F.regexp_extract(value, TIMESTAMP_PATTERN, 1)


def request(value: Column) -> Column:
    """text between the last two double quotes (greedy pattern)."""
    return F.regexp_extract(value, REQUEST_PATTERN, 1)


def token_from_end(value: Column, position: int) -> Column:
    """the ``position``-th space-separated token counted from the end (-1 = last); NULL if absent."""
    return F.try_element_at(F.split(value, " "), F.lit(position))


def tolerant_int(c: Column) -> Column:
    """int cast that gives NULL for ``-``, ``''`` and other non-numbers."""
    return c.try_cast("int")


def day_of_month(ts_text: Column) -> Column:
    """day number from ``dd/MMM/yyyy...`` text."""
    return tolerant_int(F.regexp_extract(ts_text, DAY_PATTERN, 1))


def hour_of_day(ts_text: Column) -> Column:
    """hour number from ``dd/MMM/yyyy:HH:...`` text."""
    return tolerant_int(F.regexp_extract(ts_text, HOUR_PATTERN, 1))


def typed_timestamp(ts_text: Column) -> Column:
    """Optional typed timestamp; malformed text gives NULL."""
    return F.try_to_timestamp(ts_text, F.lit(TIMESTAMP_FORMAT))


def parse_log(lines: DataFrame, value_col: str = "value", with_ts: bool = False) -> DataFrame:
    """Parse ``value`` lines into the seven log fields (one narrow projection, no shuffle)."""
    v = F.col(value_col)
    ts = timestamp_text(v)
    cols = [
        host(v).alias("host"),
        ts.alias("timestamp"),
        request(v).alias("request"),
        tolerant_int(token_from_end(v, -2)).alias("reply_code"),
        tolerant_int(token_from_end(v, -1)).alias("reply_bytes"),
    ]
    parsed = lines.select(*cols)
    parsed = parsed.withColumns({
        "day": day_of_month(F.col("timestamp")),
        "hour": hour_of_day(F.col("timestamp")),
    })
    if with_ts:
        parsed = parsed.withColumn("ts", typed_timestamp(F.col("timestamp")))
    return parsed
