"""Tuned GLMs on categorical features (C5): Poisson regression of a count
label, L2 and elastic-net logistic regression of a binary label.

The categorical encoding is fitted on the training part only and applied to
both parts; each family is tuned by k-fold grid search and its refitted best
model is scored on the held-out part. Every answer is a DataFrame: validation
curves, best grid points, the elastic-net matrix and the held-out report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.recode import binary_recode
from quarry.operators import features as E
from quarry.operators import models as M
from quarry.operators import tuning as G
from quarry.operators.aggregates import class_distribution
from quarry.operators.metrics import GroupedRmse, accuracy, accuracy_evaluator, grouped_rmse
from quarry.operators.splits import FOLD_SALT, SEED, hash_split, with_fold
from quarry.session import settled, small_answer


def prepare_binary_label(df: DataFrame, text_col: str, negative_value, out_col: str) -> DataFrame:
    """text label -> 0 for ``negative_value``, else 1."""
    return df.withColumn(out_col, binary_recode(F.col(text_col), negative_value))


def split_encounters(df: DataFrame, id_cols: Sequence[str], train_fraction: float = 0.8):
    """Reproducible train / test parts (hash of the row key)."""
    return hash_split(df, list(id_cols), train_fraction)


#: Columns of ``grouped_rows``.
N_ROWS, SQUARES = "_n_rows", "_squares"


def grouped_rows(df: DataFrame, keys: Sequence[str], count_label: str) -> DataFrame:
    """One row for each combination of ``keys``: how many rows have it, the mean of their count label
    and its squared deviations from that mean.

    All that a likelihood or an error needs of rows with the same categories. Labels
    that no count model takes (NULL, negative) stay apart and fail in the fit.
    """
    y = F.col(count_label).cast("double")
    n = F.count(F.lit(1)).cast("double")
    return (df.groupBy(*keys, (y >= 0).alias("_count"))
            .agg(n.alias(N_ROWS), F.avg(y).alias(count_label), (F.var_pop(y) * n).alias(SQUARES)).drop("_count"))


def tune_glms(train: DataFrame, test: DataFrame, cat_cols: Sequence[str], count_label: str,
              binary_label: str, reg_params: Sequence[float] = G.REG_PARAMS,
              en_params: Sequence[float] = G.ELASTIC_NET_PARAMS, folds: int = G.CV_FOLDS,
              parallelism: int = 4, seed: int = SEED, handle_invalid: str = "error",
              id_cols: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """C5. A category unseen in training fails at scoring time;
    ``handle_invalid="keep"`` maps it to one extra slot instead. With ``id_cols`` the CV
    folds are hash buckets of the row key (the same on any partitioning);
    without, they are drawn from ``seed``.

    Each part is read once, into one row for each
    combination of categories, fold and class with the number of its rows;
    the indexer and all fits and metrics of the grid take these numbers as weights, so a fit
    costs as much as there are combinations, whatever the rows."""
    spark = train.sparkSession
    fold_col = "cv_fold"
    if id_cols:
        folded = with_fold(train, list(id_cols), folds, fold_col, salt=FOLD_SALT)
    else:
        folded = train.withColumn(fold_col, F.floor(F.rand(seed) * folds).cast("int"))
    tr = settled(grouped_rows(folded, [*cat_cols, binary_label, fold_col], count_label))
    te = settled(grouped_rows(test, [*cat_cols, binary_label], count_label))
    # A5: class counts of both parts
    split_dist = small_answer(tr.select(F.lit("train").alias("split"), binary_label, N_ROWS)
                              .unionByName(te.select(F.lit("test").alias("split"), binary_label, N_ROWS))
                              .groupBy("split", binary_label).agg(F.sum(N_ROWS).cast("bigint").alias("count")))
    groups = [tr, te]
    encoder = E.categorical_pipeline(cat_cols, "features", drop_last=False, handle_invalid=handle_invalid,
                                     n_col=N_ROWS, counted=tr).fit(tr)
    keep = ["features", count_label, binary_label, N_ROWS, SQUARES]
    tr = encoder.transform(tr).select(*keep, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    te = encoder.transform(te).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    tr.count(), te.count()  # fill the caches once, before concurrent searches read them
    for df in groups:
        df.unpersist()

    families = {
        "poisson": (M.poisson_glm("features", count_label, weight_col=N_ROWS), {"regParam": reg_params},
                    GroupedRmse(count_label, N_ROWS, SQUARES), False),
        "logistic_en": (M.grouped_logistic("features", binary_label, N_ROWS),
                        {"regParam": reg_params, "elasticNetParam": en_params},
                        accuracy_evaluator(binary_label, n_col=N_ROWS), True),
    }
    shared_l2 = 0.0 in [float(e) for e in en_params]
    if not shared_l2:
        families["logistic_l2"] = (M.grouped_logistic("features", binary_label, N_ROWS), {"regParam": reg_params},
                                   accuracy_evaluator(binary_label, n_col=N_ROWS), True)
    columns = ["grid_index", "regParam", "elasticNetParam", "mean_metric", "std_metric"]

    def tune(name, est, grid_spec, evaluator, larger):
        grid = G.param_grid(est, grid_spec)
        cvm = G.cross_validate(est, grid, evaluator, tr, folds, seed, parallelism, fold_col)
        curve = G.validation_curve(spark, cvm, grid)
        if "elasticNetParam" not in curve.columns:
            curve = curve.withColumn("elasticNetParam", F.lit(None).cast("double"))
        return curve.select(F.lit(name).alias("model"), *columns), cvm.bestModel.transform(te)

    results = dict(zip(families, G.run_concurrently([lambda n=n, f=f: tune(n, *f) for n, f in families.items()], 2)))
    if shared_l2:
        # L2 is the elastic net at mixing 0 on the same folds: its points are fitted already
        points = (results["logistic_en"][0].where(F.col("elasticNetParam") == 0.0)
                  .orderBy("grid_index").collect())
        l2 = spark.createDataFrame([("logistic_l2", i, p["regParam"], None, p["mean_metric"], p["std_metric"])
                                    for i, p in enumerate(points)],
                                   "model string, grid_index int, regParam double, elasticNetParam double, "
                                   "mean_metric double, std_metric double")
        best = max(points, key=lambda p: (p["mean_metric"], -p["grid_index"]))
        model = M.grouped_logistic("features", binary_label, N_ROWS, reg_param=best["regParam"]).fit(tr)
        results["logistic_l2"] = (l2, model.transform(te))
    scored = {n: r[1] for n, r in results.items()}
    curve_all = results["poisson"][0].unionByName(results["logistic_l2"][0]).unionByName(results["logistic_en"][0])
    bests = [G.best_point(results[n][0].drop("model"), n != "poisson").withColumn("model", F.lit(n))
             for n in ("poisson", "logistic_l2", "logistic_en")]
    best_all = bests[0].unionByName(bests[1]).unionByName(bests[2])
    en_curve = curve_all.filter(F.col("model") == "logistic_en")
    matrix = G.curve_matrix(en_curve, "regParam", "elasticNetParam", en_params)

    pois = grouped_rmse(scored["poisson"], count_label, N_ROWS, SQUARES).select(
        F.lit("poisson").alias("model"), F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    accs = [accuracy(scored[m], binary_label, "prediction", n_col=N_ROWS).select(
        F.lit(m).alias("model"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
        for m in ("logistic_l2", "logistic_en")]
    report = pois.unionByName(accs[0]).unionByName(accs[1])
    # the answers are a few rows each
    out = {"split_distribution": split_dist, "curves": curve_all, "best": best_all, "en_matrix": matrix,
           "test_report": report}
    out = {k: v if k == "split_distribution" else small_answer(v) for k, v in out.items()}
    for df in (tr, te):
        df.unpersist()
    return out


def split_counts(train: DataFrame, test: DataFrame, label_col: str) -> DataFrame:
    """A5: rows per class of both parts."""
    return class_distribution(train.select(F.lit("train").alias("split"), label_col)
                              .unionByName(test.select(F.lit("test").alias("split"), label_col)), label_col, "split")
