"""Readers and writers.

All readers declare their schema up front: schema inference is an extra full
pass over the input and gives positional, data-dependent types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import settled, table_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_log_text(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row per log line in ``value``.

    Unsplittable files (``.gz``) arrive as one partition each. Where the scan
    has fewer partitions than the cluster has cores, whatever the files are
    called, a round-robin ``repartition`` spreads the parsing; ``partitions``
    asks for a number.
    """
    df = spark.read.text(path)
    if partitions is None:
        cores = spark.sparkContext.defaultParallelism
        partitions = cores if df.rdd.getNumPartitions() < cores else 0
    return df.repartition(partitions) if partitions else df


def positional_schema(n_features: int, feature_type: T.DataType = T.DoubleType(),
                      label_type: T.DataType = T.IntegerType()) -> T.StructType:
    """``_c0.._c{n-1}`` features plus ``_c{n}`` label, the names a headerless CSV gets."""
    fields = [T.StructField(f"_c{i}", feature_type, True) for i in range(n_features)]
    fields.append(T.StructField(f"_c{n_features}", label_type, True))
    return T.StructType(fields)


def headerless_width(spark: SparkSession, path: str) -> int:
    """Number of columns of a headerless CSV, from its first record."""
    return len(spark.read.option("header", "false").csv(path).columns)


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV with positional names, no inference pass."""
    return spark.read.schema(schema).option("header", "false").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             null_value: str | None = None) -> DataFrame:
    """Headed CSV with a declared schema (distributed; no pandas ingest)."""
    reader = spark.read.schema(schema).option("header", "true")
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


@dataclass(frozen=True)
class Scan:
    """The rows of one scan: ``parsed`` as declared, ``quarantined`` as (record, reason)."""

    parsed: DataFrame
    quarantined: DataFrame


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False, sep: str = ",") -> Scan:
    """S2/S3 with a sink for bad records: a record with too few or too many fields, or
    with a value of another type, is set aside whole and never turned into NULLs.

    The file is read once; both parts come from the settled scan.
    """
    bad = "_bad_record"
    declared = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = (spark.read.schema(declared).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", bad).option("columnPruning", False).csv(path))
    rows = settled(rows)
    fields = F.size(F.split(F.col(bad), re.escape(sep)))  # quoted separators only make the reason "long"
    reason = F.when(fields < len(schema), "short").when(fields > len(schema), "long").otherwise("type")
    return Scan(rows.where(F.col(bad).isNull()).drop(bad),
                rows.where(F.col(bad).isNotNull()).select(F.col(bad).alias("record"), reason.alias("reason")))


def split_features_label(columns: list[str]) -> tuple[list[str], str]:
    """All-but-last columns are features, the last one is the label."""
    return list(columns[:-1]), columns[-1]


def append_results(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None) -> None:
    """Append result rows; a new folder gets its schema (and CSV header) from the first write.

    With a ``run_id`` the rows of a run are a partition of their own, which a
    rerun replaces: a job that is repeated after a failure appends nothing twice.
    """
    writer = df.write.format(fmt)
    if run_id is not None:
        writer = (df.withColumn("run_id", F.lit(run_id)).write.format(fmt).mode("overwrite")
                  .option("partitionOverwriteMode", "dynamic").partitionBy("run_id"))
    else:
        writer = writer.mode("append")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType | str | None = None,
                 size_col: str = "sample_size") -> DataFrame:
    """Results ordered by sample size, with the size as a percentage."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return (df.withColumn(f"{size_col}_percent", F.col(size_col) * F.lit(100.0))
              .orderBy(size_col))
