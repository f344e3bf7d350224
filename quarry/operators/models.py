"""Model factories with the recorded configurations.

The estimators are MLlib's distributed implementations; this module fixes
their parameters in one place and adds the few helpers around them (item
factors, clustering, scoring).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.recommendation import ALS
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.splits import SEED

# Parameters of the recorded analyses.
GLM_MAX_ITER = 100
FIXED_RF = {"numTrees": 20, "maxDepth": 15, "maxBins": 16}
FIXED_GBT = {"maxIter": 5, "maxDepth": 10, "stepSize": 0.2}
FIXED_MLP = {"hidden": 32, "maxIter": 50, "blockSize": 64}
ALS_CONFIGS = [
    {},
    {"maxIter": 20, "rank": 20, "regParam": 0.1},
    {"maxIter": 20, "rank": 50, "regParam": 0.001},
]
KMEANS_K = 19
#: User and item blocks of ALS; raise it with the data, not with the cluster.
ALS_BLOCKS = 10
#: Ratings of a block, at most, where the blocks follow the data: a task that builds one holds it several times over.
RATINGS_PER_BLOCK = 5_000_000


def poisson_glm(features_col: str, label_col: str, reg_param: float = 0.0, max_iter: int = GLM_MAX_ITER,
                weight_col: str | None = None) -> GeneralizedLinearRegression:
    """L1: Poisson regression with log link. With ``weight_col`` a row stands for that many
    rows of the same features and its label is their mean: the equations of the fit are the same."""
    weights = {"weightCol": weight_col} if weight_col else {}
    return GeneralizedLinearRegression(family="poisson", link="log", featuresCol=features_col,
                                       labelCol=label_col, maxIter=max_iter, regParam=reg_param, **weights)


def logistic(features_col: str, label_col: str, reg_param: float = 0.0, elastic_net: float = 0.0,
             max_iter: int = GLM_MAX_ITER) -> LogisticRegression:
    """L2 / L3: binomial logistic regression, L2 (``elastic_net=0``) or elastic net."""
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, maxIter=max_iter,
                              family="binomial", regParam=reg_param, elasticNetParam=elastic_net)


class GroupedLogistic(LogisticRegression):
    """Logistic regression on distinct rows with the number of times each occurs as its weight: the fit of all rows.

    The penalty acts on features over their sample std. MLlib takes weights for
    precisions and divides by N - sum w^2 / N where N rows have N - 1, so the
    penalties are scaled by what that changes.
    """

    def _fit(self, dataset: DataFrame):
        w = F.col(self.getWeightCol())
        n, squares = dataset.agg(F.sum(w), F.sum(w * w)).first()
        if not n or n <= 1 or squares >= n * n:
            return super()._fit(dataset)
        wider = (n - 1) / (n - squares / n)  # the variance MLlib takes, over the variance of the rows
        reg, mixing = self.getRegParam(), self.getElasticNetParam()
        ridge, lasso = reg * (1 - mixing) / wider, reg * mixing / wider ** 0.5
        total = ridge + lasso
        same = self.copy({self.regParam: total, self.elasticNetParam: lasso / total if total else 0.0})
        return super(GroupedLogistic, same)._fit(dataset)


def grouped_logistic(features_col: str, label_col: str, weight_col: str, reg_param: float = 0.0, elastic_net: float = 0.0,
                     max_iter: int = GLM_MAX_ITER) -> GroupedLogistic:
    """L2 / L3: ``logistic`` on distinct rows and their numbers."""
    return GroupedLogistic(featuresCol=features_col, labelCol=label_col, weightCol=weight_col, maxIter=max_iter,
                           family="binomial", regParam=reg_param, elasticNetParam=elastic_net)


def random_forest(features_col: str, label_col: str, seed: int = SEED, **params) -> RandomForestClassifier:
    """L4: random forest classifier."""
    return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **params)


def gbt(features_col: str, label_col: str, seed: int = SEED, **params) -> GBTClassifier:
    """Gradient-boosted trees classifier."""
    return GBTClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **params)


def mlp_layers(n_features: int, hidden: int, n_classes: int = 2) -> list[int]:
    return [n_features, hidden, n_classes]


def mlp(features_col: str, label_col: str, layers: Sequence[int] | None = None, seed: int = SEED,
        **params) -> MultilayerPerceptronClassifier:
    """Multilayer perceptron with one hidden layer ``[n, h, 2]``."""
    est = MultilayerPerceptronClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, **params)
    if layers is not None:
        est = est.setLayers(list(layers))
    return est


def als(user_col: str = "userId", item_col: str = "movieId", rating_col: str = "rating",
        seed: int = SEED, checkpoint_interval: int = 1, blocks: int = ALS_BLOCKS, **params) -> ALS:
    """Explicit ALS; cold-start rows are dropped from predictions.

    ``checkpointInterval`` cuts the lineage of the factor RDDs if the deployment
    names a checkpoint folder, and with it go the shuffle files behind them: an
    iteration sends every factor to each block that needs it, so the files of a
    few iterations are many times the ratings. MLlib draws the
    start factors per block, so ``blocks`` (users and items) is part of the
    answer: it is a parameter and never follows the cluster.
    """
    params.setdefault("numUserBlocks", blocks)
    params.setdefault("numItemBlocks", blocks)
    return ALS(userCol=user_col, itemCol=item_col, ratingCol=rating_col, coldStartStrategy="drop",
               seed=seed, checkpointInterval=checkpoint_interval, **params)


def als_blocks(ratings: DataFrame) -> int:
    """Blocks for ``als`` on these ratings: the recorded number, or more where a block would outgrow a task."""
    return max(ALS_BLOCKS, -(-ratings.count() // RATINGS_PER_BLOCK))


def item_factors(model) -> DataFrame:
    """``(id INT, features ARRAY<FLOAT>)`` of a fitted ALS model."""
    return model.itemFactors


def kmeans(k: int = KMEANS_K, seed: int = SEED, features_col: str = "features",
           prediction_col: str = "cluster") -> KMeans:
    """K-means (k-means|| initialisation)."""
    return KMeans(k=k, seed=seed, featuresCol=features_col, predictionCol=prediction_col)


def cluster(df: DataFrame, k: int = KMEANS_K, seed: int = SEED, features_col: str = "features",
            id_col: str = "id") -> DataFrame:
    """L9 + L10: fit k-means and return ``(id, cluster)``."""
    model = kmeans(k, seed, features_col).fit(df)
    return model.transform(df).select(id_col, "cluster")


class SqlScore(Estimator, Model):
    """A model that is a SQL expression with one parameter, ``{k}``: a baseline that
    goes through the same grid search and evaluators as fitted models."""

    k = Param(Params._dummy(), "k", "value of the parameter", TypeConverters.toInt)

    def __init__(self, expression: str, score_col: str = "rawPrediction", k: int = 0) -> None:
        super().__init__()
        self.expression, self.score_col = expression, score_col
        self._setDefault(k=k)

    def _fit(self, dataset: DataFrame) -> SqlScore:
        return self.copy()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.score_col, F.expr(self.expression.format(k=self.getOrDefault(self.k))))
