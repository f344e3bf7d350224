"""Wide binary classification (C6): sample the training table, tune random
forest, gradient-boosted trees and a multilayer perceptron by k-fold grid
search on AUC, and report accuracy and AUC of each refitted best model on the
whole test table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.recode import percent, sign_to_binary
from quarry.operators import features as E
from quarry.operators import models as M
from quarry.operators import tuning as G
from quarry.operators.aggregates import class_distribution, row_count
from quarry.operators.metrics import auc_exact, classification_report
from quarry.operators.splits import FOLD_SALT, SEED, hash_sample, sample_by, with_fold
from quarry.session import small_answer, with_checkpoints


def recode_label(df: DataFrame, label_col: str) -> DataFrame:
    """-1 -> 0 so the label is a class index."""
    return df.withColumn(label_col, sign_to_binary(F.col(label_col)))


def draw_sample(train: DataFrame, label_col: str, fraction: float | dict, id_col: str | None = None,
                labels: Sequence | None = None, seed: int = SEED) -> DataFrame:
    """Deterministic hash sample on ``id_col``, or Spark's ``sampleBy`` when no id
    is given; a dict has a fraction per class."""
    if id_col is not None:
        return hash_sample(train, id_col, fraction, label_col=label_col)
    return sample_by(train, label_col, fraction, seed, labels)


def sample_counts(train: DataFrame, label_col: str, fraction: float, id_col: str) -> DataFrame:
    """A5: rows per class of the training part and of its hash sample."""
    train = recode_label(train, label_col)
    return class_distribution(
        train.withColumn("part", F.lit("all"))
        .unionByName(hash_sample(train, id_col, fraction).withColumn("part", F.lit("sample"))), label_col, "part")


def sample_share(counts: DataFrame) -> DataFrame:
    """rows of the training part and of the sample, and the measured share in percent."""
    n = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("count"))), F.lit(0)).alias(f"n_{p}") for p in ("all", "sample")]
    return counts.agg(*n).withColumn("percent", F.when(F.col("n_all") > 0, percent(F.col("n_sample"), F.col("n_all"))))


def family_estimator(family: str, features_col: str, label_col: str, n_features: int, params: dict | None = None,
                     seed: int = SEED):
    """Estimator ``rf`` / ``gbt`` / ``mlp`` on a vector column."""
    params = dict(params or {})
    if family == "rf":
        return M.random_forest(features_col, label_col, seed, **params)
    if family == "gbt":
        return M.gbt(features_col, label_col, seed, **params)
    if family == "mlp":
        hidden = params.pop("hidden", None)
        return M.mlp(features_col, label_col, M.mlp_layers(n_features, hidden) if hidden else None, seed, **params)
    raise ValueError(family)


def family_pipeline(family: str, feature_cols: Sequence[str], label_col: str, n_features: int,
                    params: dict | None = None, scale: bool = False, seed: int = SEED):
    """Assembler (+ scaler) + estimator."""
    stages = [E.assembler(feature_cols, "assembled")] + ([E.standardizer("assembled", "scaled")] if scale else [])
    est = family_estimator(family, "scaled" if scale else "assembled", label_col, n_features, params, seed)
    return Pipeline(stages=[*stages, est]), est


def _grid_for(family: str, est, spec: dict, n_features: int) -> list:
    spec = dict(spec)
    if family == "mlp" and "hidden" in spec:
        spec = {"layers": [M.mlp_layers(n_features, h) for h in spec.pop("hidden")], **spec}
    return G.param_grid(est, spec)


#: Rows of vectors in a partition: a sample of a few thousand rows is one task, a large one as many as it needs.
ROWS_PER_PARTITION = 20_000


def _vectors(df: DataFrame, feature_cols: Sequence[str], label_col: str, *more: str) -> DataFrame:
    """(label, assembled, more), computed once and kept; the features are never assembled again."""
    vectors = E.assembler(feature_cols, "assembled").transform(df).select(F.col(label_col).cast("double").alias(label_col),
                                                                          "assembled", *more)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, -(-vectors.count() // ROWS_PER_PARTITION))
    if parts >= vectors.rdd.getNumPartitions():
        return vectors
    few = vectors.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    few.count()
    vectors.unpersist()
    return few


class WideTuning:
    """The sample and the test rows as vectors, cached; each family is tuned on its own.

    ``release`` drops the caches.
    """

    def __init__(self, train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label_col: str,
                 fraction: float | dict = 0.01, id_col: str | None = None, folds: int = G.CV_FOLDS,
                 parallelism: int = 1, seed: int = SEED) -> None:
        with_checkpoints(train.sparkSession)
        self.spark, self.label_col, self.seed, self.parallelism = train.sparkSession, label_col, seed, parallelism
        self.n_features = len(feature_cols)
        sample = recode_label(draw_sample(train, label_col, fraction, id_col, seed=seed), label_col)
        if id_col is not None:  # reproducible CV folds: hash buckets of the row key
            sample = with_fold(sample, id_col, folds, "cv_fold", salt=FOLD_SALT)
        else:
            sample = sample.withColumn("cv_fold", F.floor(F.rand(seed) * folds).cast("int"))
        self.sample = _vectors(sample, feature_cols, label_col, "cv_fold")
        self.test = _vectors(recode_label(test, label_col), feature_cols, label_col)
        self.folds = range(folds)
        self.distribution = small_answer(class_distribution(
            recode_label(train, label_col).select(label_col, F.lit("all").alias("part"))
            .unionByName(self.sample.select(F.col(label_col).cast("int").alias(label_col), F.lit("sample").alias("part"))),
            label_col, "part"))
        self.n_test = small_answer(row_count(self.test, "n_test"))
        self._kept = [self.sample, self.test]

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def _scaled(self, fitted_on: DataFrame, *frames: DataFrame) -> list[DataFrame]:
        model = E.standardizer("assembled", "scaled").fit(fitted_on)
        return [self._keep(model.transform(df).drop("assembled")) for df in frames]

    def tune(self, family: str, spec: dict) -> dict[str, DataFrame]:
        """``curve``, ``best`` and ``test_report`` of one family, on all points of its grid."""
        scale = family == "mlp"  # the perceptron standardises its inputs, on the training rows of a fold
        pairs = [(self.sample.where(F.col("cv_fold") != k), self.sample.where(F.col("cv_fold") == k)) for k in self.folds]
        if scale:
            pairs = [tuple(self._scaled(train, train, valid)) for train, valid in pairs]
        est = family_estimator(family, "scaled" if scale else "assembled", self.label_col, self.n_features, seed=self.seed)
        grid = _grid_for(family, est, spec, self.n_features)
        scores = G.search_folds(est, grid, pairs, self.parallelism)
        aucs = auc_exact(scores, self.label_col, "score", ["grid_index", "fold"])  # a row for each grid point and fold
        points = aucs.groupBy("grid_index").agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std")).orderBy("grid_index").collect()
        means, stds = [p["mean"] for p in points], [p["std"] for p in points]
        curve = G.curve_of(self.spark, grid, means, stds)
        params = [c for c in curve.columns if c not in ("grid_index", "mean_metric", "std_metric")]
        packed = curve.select(F.lit(family).alias("model"), "grid_index", F.to_json(F.struct(*map(F.col, params))).alias("params"),
                              "mean_metric", "std_metric")
        best = small_answer(G.best_point(packed.drop("model"), True).withColumn("model", F.lit(family)))
        train, test = self._scaled(self.sample, self.sample, self.test) if scale else (self.sample, self.test)
        model = est.fit(train, grid[best.first()["grid_index"]])
        report = classification_report(model.transform(test), self.label_col).withColumn("model", F.lit(family))
        return {"curve": small_answer(packed), "best": best, "test_report": small_answer(report)}


#: The recorded grids of 27 points each.
FAMILY_GRIDS = {"rf": G.RF_GRID, "gbt": G.GBT_GRID, "mlp": G.MLP_GRID}


def tune_wide(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label_col: str,
              fraction: float | dict = 0.01, id_col: str | None = None,
              grids: dict | None = None, folds: int = G.CV_FOLDS, parallelism: int = 1,
              seed: int = SEED) -> dict[str, DataFrame]:
    """C6 for all families. ``grids`` maps ``rf`` / ``gbt`` / ``mlp`` to parameter grids
    (default: the recorded 27-point grids). MLP standardises its inputs."""
    work = WideTuning(train, test, feature_cols, label_col, fraction, id_col, folds, parallelism, seed)
    found = [work.tune(family, spec) for family, spec in (grids or FAMILY_GRIDS).items()]
    work.release()
    return {"class_distribution": work.distribution, "sample_share": sample_share(work.distribution), "n_test": work.n_test,
            "curves": G.united([f["curve"] for f in found]), "best": G.united([f["best"] for f in found]),
            "test_report": G.united([f["test_report"] for f in found])}

