"""Sample-size scaling study (C7) and its report.

For each training fraction (nested hash samples: 20 % is inside 40 %) and
each model family with fixed parameters, fit, score the whole test table and
evaluate accuracy and AUC, timing all three steps. Results come back as a
long table and as the wide results table the study appends to (S5).
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators.metrics import classification_report
from quarry.operators.splits import SEED, hash_sample
from quarry.plans.wide import family_pipeline, recode_label
from quarry.sources.tables import append_results, read_results

# The recorded sample-size sweep.
SAMPLE_SIZES = [0.2, 0.4, 0.6, 0.8]
FAMILIES = ("rf", "gbt", "mlp")
FIXED_PARAMS = {"rf": M.FIXED_RF, "gbt": M.FIXED_GBT, "mlp": M.FIXED_MLP}


def scaling_study(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label_col: str,
                  id_col: str, fractions: Sequence[float] = SAMPLE_SIZES, families: Sequence[str] = FAMILIES,
                  params: dict | None = None, results_path: str | None = None,
                  seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Returns ``(long, wide)``; ``long`` is ``(sample_size, sample_count,
    model, accuracy, auc, seconds)``; ``wide`` has one row per size with
    ``{model}_{accuracy,auc,time}`` columns and is appended to ``results_path``."""
    spark = train.sparkSession
    params = params or FIXED_PARAMS
    n = len(feature_cols)
    test_r = recode_label(test, label_col).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for f in fractions:
        sample = recode_label(hash_sample(train, id_col, f), label_col).persist(StorageLevel.MEMORY_AND_DISK)
        count = sample.count()
        for fam in families:
            pipe, _ = family_pipeline(fam, feature_cols, label_col, n, params.get(fam), seed=seed)
            t0 = time.perf_counter()
            model = pipe.fit(sample)
            rep = classification_report(model.transform(test_r), label_col).first()
            rows.append((float(f), int(count), fam, float(rep["accuracy"]), float(rep["auc"]),
                         time.perf_counter() - t0))
        sample.unpersist()
    test_r.unpersist()
    long = spark.createDataFrame(rows, "sample_size double, sample_count bigint, model string, "
                                       "accuracy double, auc double, seconds double")
    wide = wide_results(long, families)
    if results_path is not None:
        append_results(wide, results_path)
    return long, wide


def wide_results(long: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """One row per sample size, ``{model}_{accuracy,auc,time}`` columns (pivot on given values)."""
    w = long.groupBy("sample_size", "sample_count").pivot("model", list(families)).agg(
        F.first("accuracy").alias("accuracy"), F.first("auc").alias("auc"), F.first("seconds").alias("time"))
    return w


def scaling_report(spark: SparkSession, results_path: str, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Results sorted by size in long form ``(sample_size_percent,
    sample_count, model, accuracy, auc, seconds, rows_per_second)``."""
    return report_of(read_results(spark, results_path), families)


def report_of(wide: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """The report from results read by ``read_results``."""
    stack = ", ".join(f"'{m}', `{m}_accuracy`, `{m}_auc`, `{m}_time`" for m in families)
    long = wide.selectExpr("sample_size_percent", "sample_count",
                           f"stack({len(families)}, {stack}) AS (model, accuracy, auc, seconds)")
    return (long.withColumn("rows_per_second", F.col("sample_count") / F.col("seconds"))
                .orderBy("sample_size_percent", "model"))
