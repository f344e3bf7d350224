"""Grid search (G1-G5) and metric tables.

``CrossValidator`` fits grid x folds models (``parallelism`` of them at a
time) and refits the best on all rows. The fitted metadata is turned into
DataFrames: validation curve (mean and population std per grid point), best
parameters, and a 2-D matrix for two-parameter grids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.aggregates import arg_best
from quarry.operators.compiled import export_trees, features_array
from quarry.operators.grids import metric_matrix
from quarry.operators.metrics import class_score
from quarry.operators.splits import SEED
from quarry.session import settled

# The recorded grids.
REG_PARAMS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
ELASTIC_NET_PARAMS = [0.0, 0.2, 0.5, 0.8, 1.0]
RF_GRID = {"numTrees": [10, 15, 20], "maxDepth": [5, 10, 15], "maxBins": [16, 32, 64]}
GBT_GRID = {"maxDepth": [5, 8, 10], "maxIter": [10, 20, 50], "stepSize": [0.01, 0.1, 0.2]}
MLP_GRID = {"hidden": [64, 32, 16], "maxIter": [10, 20, 50], "blockSize": [16, 32, 64]}
CV_FOLDS = 3


def param_grid(estimator, grid: dict[str, Sequence]) -> list:
    """G1: cartesian grid; the last parameter varies fastest."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def cross_validate(estimator, param_maps: list, evaluator, data: DataFrame, folds: int = CV_FOLDS,
                   seed: int = SEED, parallelism: int = 1, fold_col: str | None = None) -> CrossValidatorModel:
    """K-fold grid search, then refit of the best model on all of ``data``.

    ``fold_col`` gives user-defined (e.g. hash-based, reproducible) folds.
    """
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_maps, evaluator=evaluator,
                        numFolds=folds, seed=seed, parallelism=parallelism)
    if fold_col is not None:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(data)


@dataclass(frozen=True)
class Point:
    """A grid point of boosted trees: its place in the grid, its steps and its depth."""

    index: int
    steps: int
    depth: int


def boosting_groups(estimator, param_maps: list) -> list[tuple[dict, list[Point]]]:
    """The grid points that differ in ``maxIter`` and ``maxDepth`` only, with their other parameters."""
    steps, depth = estimator.getParam("maxIter"), estimator.getParam("maxDepth")
    groups: dict[tuple, tuple[dict, list[Point]]] = {}
    for i, params in enumerate(param_maps):
        rest = {p: v for p, v in params.items() if p not in (steps, depth)}
        key = tuple(sorted((p.name, str(v)) for p, v in rest.items()))
        groups.setdefault(key, (rest, []))[1].append(
            Point(i, params.get(steps, estimator.getOrDefault(steps)), params.get(depth, estimator.getOrDefault(depth))))
    return list(groups.values())


def served(points: Sequence[Point], steps: int, depth: int, tree_depths: Sequence[int]) -> list[Point]:
    """The points whose model is the start of a fit with ``steps`` trees of at most ``depth``.

    Boosting adds one tree after the other, so a shorter fit is the start of a
    longer one.  A smaller depth changes nothing until a tree goes deeper.
    """
    return [p for p in points if p.steps <= steps and p.depth <= depth
            and (p.depth == depth or max(tree_depths[:p.steps], default=0) <= p.depth)]


def boosted_fits(estimator, rest: dict, points: Sequence[Point], train: DataFrame) -> Iterator[tuple[object, list[Point]]]:
    """Models and the points that each serves, one by one: the deepest and longest first, then what it leaves."""
    steps, depth = estimator.getParam("maxIter"), estimator.getParam("maxDepth")
    left = list(points)
    while left:
        deepest = max(p.depth for p in left)
        longest = max(p.steps for p in left if p.depth == deepest)
        model = estimator.fit(train, {**rest, steps: longest, depth: deepest})
        done = served(left, longest, deepest, [t.depth for t in model.trees])
        yield model, done
        del model
        left = [p for p in left if p not in done]


def fit_boosted(estimator, rest: dict, points: Sequence[Point], train: DataFrame) -> list[tuple[object, list[Point]]]:
    """``boosted_fits``, all kept."""
    return list(boosted_fits(estimator, rest, points, train))


def prefix_scores(model, data: DataFrame, label_col: str, features_col: str, points: Sequence[tuple[int, int]]) -> DataFrame:
    """(label, grid_index, score): the margins of the first ``n`` trees of a boosted
    ensemble for every (grid index, n) of ``points``, in one pass over ``data``."""
    margins = export_trees(data.sparkSession, model).margins(features_array(features_col), [n for _, n in points])
    index = F.array(*[F.lit(i) for i, _ in points])
    return (data.select(F.col(label_col), F.posexplode(margins).alias("place", "score"))
            .select(label_col, F.get(index, F.col("place")).alias("grid_index"), "score"))


def search_folds(estimator, param_maps: list, folds: Sequence[tuple[DataFrame, DataFrame]], parallelism: int = 4) -> DataFrame:
    """G2 on given (training, validation) folds: ``(label, grid_index, fold, score)`` of
    every validation row at every grid point.

    Fits run side by side, ``parallelism`` at a time, over all folds.  A model
    scores its validation rows as soon as it is fitted and goes: what is left of
    it are its scores, so no plan holds the nodes of many models.  The metric is
    taken of all scores in one aggregate.  Boosted trees are fitted once for all
    points that a fit serves.
    """
    label, features = estimator.getLabelCol(), estimator.getFeaturesCol()
    boosted = isinstance(estimator, GBTClassifier)

    def one(fold: int, index: int) -> DataFrame:
        train, valid = folds[fold]
        scored = estimator.fit(train, param_maps[index]).transform(valid)
        return settled(scored.select(label, F.lit(index).alias("grid_index"), class_score(scored, "rawPrediction").alias("score"),
                                     F.lit(fold).alias("fold")))

    def several(fold: int, rest: dict, points: list[Point]) -> DataFrame:
        train, valid = folds[fold]
        return united([settled(prefix_scores(model, valid, label, features, [(p.index, p.steps) for p in done])
                               .withColumn("fold", F.lit(fold)))
                       for model, done in boosted_fits(estimator, rest, points, train)])

    jobs = [lambda k=k, g=g: several(k, *g) for k in range(len(folds)) for g in boosting_groups(estimator, param_maps)] if boosted else \
           [lambda k=k, i=i: one(k, i) for k in range(len(folds)) for i in range(len(param_maps))]
    return united(run_concurrently(jobs, parallelism))


def united(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _param_value(v):
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _sql_type(v) -> str:
    return "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string"


def validation_curve(spark: SparkSession, cv_model: CrossValidatorModel, param_maps: list) -> DataFrame:
    """One row per grid point: ``grid_index``, the parameters, ``mean_metric``, ``std_metric``.

    ``std_metric`` is the population std over folds (what CrossValidator reports).
    """
    return curve_of(spark, param_maps, cv_model.avgMetrics, cv_model.stdMetrics)


def curve_of(spark: SparkSession, param_maps: list, means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    """``validation_curve`` of given means and stds."""
    names = [p.name for p in param_maps[0].keys()]
    rows = []
    for i, (pm, mean, std) in enumerate(zip(param_maps, means, stds, strict=True)):
        vals = {p.name: _param_value(v) for p, v in pm.items()}
        rows.append((i, *[vals[n] for n in names], float(mean), float(std)))
    types = []
    for n in names:
        sample = rows[0][1 + names.index(n)]
        types.append(f"`{n}` {_sql_type(sample)}")
    schema = ", ".join(["grid_index int", *types, "mean_metric double", "std_metric double"])
    return spark.createDataFrame(rows, schema)


def best_point(curve: DataFrame, larger_is_better: bool) -> DataFrame:
    """The best grid point on unrounded means, first on ties."""
    payload = [c for c in curve.columns if c not in ("grid_index", "mean_metric")]
    return arg_best(curve, "mean_metric", "grid_index", larger_is_better, payload_cols=payload)


def best_params(spark: SparkSession, cv_model: CrossValidatorModel, names: Sequence[str]) -> DataFrame:
    """The refitted best model's parameters as a one-row DataFrame."""
    best = cv_model.bestModel
    stage = best.stages[-1] if hasattr(best, "stages") else best
    vals = {n: _param_value(stage.getOrDefault(stage.getParam(n))) for n in names}
    schema = ", ".join(f"`{n}` {_sql_type(v)}" for n, v in vals.items())
    return spark.createDataFrame([tuple(vals[n] for n in names)], schema)


def curve_matrix(curve: DataFrame, row_param: str, col_param: str, col_values: Sequence) -> DataFrame:
    """Mean metric as a ``row_param`` x ``col_param`` matrix."""
    return metric_matrix(curve, row_param, col_param, "mean_metric", [float(v) for v in col_values])


def rounded(curve: DataFrame, digits: int = 4) -> DataFrame:
    """display rounding of a curve (after ``best_point``)."""
    return curve.withColumns({"mean_metric": F.round("mean_metric", digits),
                              "std_metric": F.round("std_metric", digits)})


def run_concurrently(tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Run independent model fits as concurrent Spark jobs (like CrossValidator's
    ``parallelism``); results keep the order of ``tasks``."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        return list(pool.map(lambda t: t(), tasks))
