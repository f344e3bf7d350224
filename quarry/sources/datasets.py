"""Readers for the original public inputs of the four analyses, each with a
declared schema (no inference pass) so a user can point the plans at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.recode import binary_recode
from quarry.sources.tables import headerless_width, positional_schema, read_csv, read_headerless_csv, read_log_text

# The 23 medication columns of the hospital-encounters table.
MEDICATION_COLUMNS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide",
    "glimepiride", "acetohexamide", "glipizide", "glyburide",
    "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "examide",
    "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
]
ENCOUNTER_ID = "encounter_id"


def access_log(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Access-log text, spread over the cluster where the scan has few partitions."""
    return read_log_text(spark, path, partitions)


def encounters(spark: SparkSession, path: str) -> DataFrame:
    """Hospital encounters CSV: every column read as text (no inference pass),
    ``?`` as NULL; ``readmitted`` recoded ``NO`` -> 0 else 1 (F10) and
    ``time_in_hospital`` cast to double (F12)."""
    df = spark.read.option("header", "true").option("nullValue", "?").csv(path)
    return df.withColumns({
        "readmitted": binary_recode(F.col("readmitted"), "NO"),
        "time_in_hospital": F.col("time_in_hospital").cast("double"),
    })


def challenge_response(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """Headerless numeric CSV: all columns but the last are features, the last
    is the label in {-1, 1}; the width is that of the first record."""
    width = headerless_width(spark, path)
    if n_features is not None and n_features != width - 1:
        raise ValueError(f"{path} has {width - 1} feature columns, not {n_features}")
    return read_headerless_csv(spark, path, positional_schema(width - 1))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """``userId INT, movieId INT, rating FLOAT`` (the timestamp column is dropped)."""
    df = read_csv(spark, path, "userId INT, movieId INT, rating FLOAT, timestamp LONG")
    return df.select("userId", "movieId", "rating")


def genome_scores(spark: SparkSession, path: str) -> DataFrame:
    """``movieId INT, tagId INT, relevance DOUBLE``."""
    return read_csv(spark, path, "movieId INT, tagId INT, relevance DOUBLE")


def genome_tags(spark: SparkSession, path: str) -> DataFrame:
    """``tagId INT, tag STRING``."""
    return read_csv(spark, path, "tagId INT, tag STRING")
