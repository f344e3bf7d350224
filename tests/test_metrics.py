import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import types as T

from quarry.operators.metrics import accuracy, auc_exact, regression_metrics, valid_predictions


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    num = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return num / (len(pos) * len(neg))


def test_auc_exact_with_ties_five_rows(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert auc_exact(df, "y", "s").first().auc == pytest.approx(_brute_auc(rows))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_auc_exact_matches_brute_force_across_partitions(spark, partitions):
    rnd = random.Random(7)
    rows = [(g, int(rnd.random() < 0.4), round(rnd.random(), 2)) for g in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r.auc for r in auc_exact(df, "y", "s", "g", partitions=partitions).collect()}
    for g in ("a", "b"):
        assert got[g] == pytest.approx(_brute_auc([(y, s) for gg, y, s in rows if gg == g]), abs=1e-12)


def test_auc_exact_equals_evaluator_on_few_distinct_scores(spark):
    rnd = random.Random(3)
    rows = [(float(int(rnd.random() < 0.5)), round(rnd.random(), 3)) for _ in range(500)]
    schema = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("s", T.DoubleType()),
                           T.StructField("raw", VectorUDT())])
    df = spark.createDataFrame([(y, s, Vectors.dense([1 - s, s])) for y, s in rows], schema)
    ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="raw", metricName="areaUnderROC")
    assert auc_exact(df, "y", "s").first().auc == pytest.approx(ev.evaluate(df), abs=1e-9)


def test_regression_metrics_and_accuracy(spark):
    y = np.array([1.0, 2.0, 3.0, 4.0])
    p = np.array([1.5, 2.0, 2.0, 5.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, prediction double")
    r = regression_metrics(df, "y").first()
    assert r.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert accuracy(df, "y").first().accuracy == pytest.approx(0.25)


def test_valid_predictions_drops_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "prediction double")
    assert df.filter("prediction IS NOT NULL").count() == 2
    assert valid_predictions(df).count() == 1
