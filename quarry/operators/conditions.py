"""What a fitted model has to satisfy, checked on all rows.

MLlib returns coefficients, factors and centres; these functions compute from
the data the equations that the optimum obeys, one grouped aggregate each, and
count what violates them. They tell a wrong fit from a right one without a
second implementation of the fit.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.compiled import dot


# ---------------------------------------------------------------- L1-L3: score equations
def score_sums(df: DataFrame, features_col: str, residual: Column, n_col: str | None = None) -> DataFrame:
    """(j, score, std): for each feature the mean of residual times value over all rows and the sample std of the feature.

    Only values other than zero are sent on, so one-hot features cost one row
    for each category of a row. A row stands for ``n_col`` rows with the same
    features and, on average, this residual.
    """
    w = F.lit(1) if n_col is None else F.col(n_col)
    n = df.agg(F.sum(w)).first()[0] or 0
    active = (df.select(residual.alias("_r"), w.alias("_w"), F.posexplode(vector_to_array(F.col(features_col))).alias("j", "_x"))
              .where("_x <> 0"))
    sums = active.groupBy("j").agg(F.sum(F.col("_w") * F.col("_r") * F.col("_x")).alias("_rx"),
                                   F.sum(F.col("_w") * F.col("_x")).alias("_s"),
                                   F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_ss"))
    variance = (F.col("_ss") - F.col("_s") * F.col("_s") / n) / (n - 1)
    return sums.select("j", (F.col("_rx") / n).alias("score"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"))


def elastic_net_violations(df: DataFrame, model, residual: Column, reg_param: float, elastic_net: float,
                           tolerance: float = 1e-3, n_col: str | None = None) -> DataFrame:
    """(n_coefficients, violations) of the optimality conditions of a penalised fit.

    On standardised features, with score s = mean(residual * x) / std and
    coefficient b: s + reg * (1 - mixing) * b + reg * mixing * sign(b) = 0 where
    b is not zero, and abs(s) <= reg * mixing where it is.
    """
    spark = df.sparkSession
    fitted = spark.createDataFrame(list(enumerate(map(float, model.coefficients.toArray()))), "j int, beta double")
    both = fitted.join(score_sums(df, model.getFeaturesCol(), residual, n_col), "j", "left")
    b = F.col("beta") * F.col("std")
    s = F.when(F.col("std") > 0, F.col("score") / F.col("std")).otherwise(0.0)
    ridge, lasso = F.lit(reg_param * (1 - elastic_net)) * b, F.lit(reg_param * elastic_net)
    off = F.when(F.col("std").isNull() | (F.col("std") == 0), F.abs("beta")) \
           .when(F.col("beta") == 0, F.abs(s) - lasso).otherwise(F.abs(s + ridge + lasso * F.signum("beta")))
    return both.agg(F.count(F.lit(1)).alias("n_coefficients"), F.count_if(off > tolerance).alias("violations"))


# ---------------------------------------------------------------- L7: normal equations
def als_residuals(ratings: DataFrame, user_factors: DataFrame, item_factors: DataFrame, rank: int, reg_param: float,
                  user_col: str = "userId", item_col: str = "movieId", rating_col: str = "rating") -> DataFrame:
    """(user, residual): the largest entry of (sum v v' + reg n I) u - sum r v over a user's n ratings,
    relative to the largest of sum r v. The user factors come last in an iteration, so they solve it."""
    users = user_factors.select(F.col("id").alias(user_col), F.col("features").cast("array<double>").alias("_u"))
    items = item_factors.select(F.col("id").alias(item_col), F.col("features").cast("array<double>").alias("_v"))
    rated = (ratings.select(user_col, item_col, F.col(rating_col).cast("double").alias("_r"))
             .join(items, item_col).join(users, user_col))
    error = dot(F.col("_u"), F.col("_v")) - F.col("_r")
    rated = rated.withColumn("_e", error)
    sums = rated.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_u").alias("_u"),
        F.array(*[F.sum(F.get("_v", F.lit(k)) * F.col("_e")) for k in range(rank)]).alias("_left"),
        F.array(*[F.sum(F.get("_v", F.lit(k)) * F.col("_r")) for k in range(rank)]).alias("_right"))
    rest = F.zip_with("_left", "_u", lambda e, u: F.abs(e + F.lit(reg_param) * F.col("_n") * u))
    size = F.array_max(F.transform("_right", F.abs))
    return sums.select(user_col, (F.array_max(rest) / (size + 1e-9)).alias("residual"))


# ---------------------------------------------------------------- L9: Lloyd's conditions
def centre_mismatches(df: DataFrame, centres: list[list[float]], features_col: str, cluster_col: str,
                      tolerance: float = 1e-6) -> DataFrame:
    """(n, not_nearest, centres_off): rows that another centre is nearer to, and centres that aren't the mean of their rows."""
    spark, width = df.sparkSession, len(centres[0])
    table = F.array(*[F.array(*[F.lit(float(c)) for c in centre]) for centre in centres])
    x = F.col(features_col).cast("array<double>")

    def distance(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    measured = df.select(F.col(cluster_col).alias("_c"), x.alias("_x"),
                         F.transform(table, lambda c: distance(x, c)).alias("_d"))
    own = F.get("_d", F.col("_c"))
    by_cluster = measured.groupBy("_c").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(own > F.array_min("_d") + tolerance).alias("_far"),
        F.array(*[F.avg(F.get("_x", F.lit(k))) for k in range(width)]).alias("_mean"))
    fitted = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "_c int, _centre array<double>")
    off = distance(F.col("_mean"), F.col("_centre")) > tolerance
    return (fitted.join(by_cluster, "_c", "left")
            .agg(F.sum("_n").alias("n"), F.sum("_far").alias("not_nearest"),
                 F.count_if(F.col("_mean").isNull() | off).alias("centres_off")))
