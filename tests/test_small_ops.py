"""The small operators that the plans do not call directly."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.functions.recode import to_double, to_int
from quarry.operators import aggregates, features, joins, splits


def test_random_fold_and_subtract_split(spark):
    df = spark.range(3000).withColumn("label", (F.col("id") % 2).cast("int"))
    folds = {r.fold for r in splits.random_fold(df, 4).select("fold").distinct().collect()}
    assert folds == {0, 1, 2, 3}
    train, test = splits.subtract_split(df, "label", 0.8, [0, 1])
    n_train, n_test = train.count(), test.count()
    assert n_train + n_test == 3000 and 2200 < n_train < 2600


def test_array_features_and_vector_elements(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],)], "a array<double>")
    out = features.vector_elements(features.array_features(df.filter("a[1] is not null"), "a", "v"), "v", "back")
    assert out.first().back == [1.0, 2.0]


def test_casts_mean_count_and_membership(spark):
    df = spark.createDataFrame([("1", "g", 2.0), ("2", "g", 4.0), ("3", "h", 1.0), (None, "h", 3.0)],
                               "s string, g string, x double")
    got = df.select(to_int(F.col("s")).alias("i"), to_double(F.col("s")).alias("d")).collect()
    assert [r.i for r in got] == [1, 2, 3, None] and got[0].d == 1.0
    means = {r.g: r.avg_x for r in aggregates.mean_per_group(df, "g", "x").collect()}
    assert means == {"g": 3.0, "h": 2.0}
    assert aggregates.row_count(df).first()["count"] == 4
    assert joins.keep_members(df, "g", values=["h"]).count() == 2
    members = spark.createDataFrame([("g",)], "g string")
    assert joins.keep_members(df, "g", members=members).count() == 2


def test_joins_are_plain_or_bounded(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    small = spark.range(20).withColumnRenamed("id", "k")
    assert joins.join_bounded(big, small, "k").count() == 20
    assert joins.keep_members(big, "k", members=small.union(small)).count() == 20
