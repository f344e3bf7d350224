"""Fitted models as column expressions.

``compile_model`` turns a fitted linear model, tree ensemble or multilayer
perceptron into one JVM expression over the features array, without a UDF and
without the model: the weights are array literals, a tree is walked by its
node arrays.  The expression can be stored, shared by queries and pushed into
any plan; it also gives what ``transform`` does not, such as the margins of
the first steps of a boosted ensemble.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.session import work_folder


def _numbers(values: Sequence, kind: str = "double") -> Column:
    """An array literal; folded once, however long."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def _rows_of(values: Sequence[Sequence[float]]) -> Column:
    return F.array(*[_numbers(v) for v in values])


def features_array(features_col: str) -> Column:
    return vector_to_array(F.col(features_col))


def dot(a: Column, b: Column, start: float = 0.0) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(float(start)), lambda s, x: s + x)


def linear(coefficients: Sequence[float], intercept: float, x: Column) -> Column:
    """Intercept plus the dot product."""
    return dot(x, _numbers([float(c) for c in coefficients]), intercept)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# ---------------------------------------------------------------- trees
@dataclass(frozen=True)
class Trees:
    """The nodes of all trees of an ensemble, numbered through; a leaf has no children (-1)."""

    roots: list[int]
    weights: list[float]
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    depth: int

    def leaf_values(self, x: Column) -> Column:
        """Array: what each tree predicts."""
        feature, left, right = (_numbers(v, "int") for v in (self.feature, self.left, self.right))
        threshold, value = _numbers(self.threshold), _numbers(self.value)

        def step(node: Column, _: Column) -> Column:
            below = F.get(x, F.get(feature, node)) <= F.get(threshold, node)
            return F.when(F.get(left, node) < 0, node).when(below, F.get(left, node)).otherwise(F.get(right, node))

        steps = F.sequence(F.lit(1), F.lit(max(self.depth, 1)))
        return F.transform(_numbers(self.roots, "int"), lambda root: F.get(value, F.aggregate(steps, root, step)))

    def margin(self, x: Column, n_trees: int | None = None) -> Column:
        """Weighted sum of the first ``n_trees`` trees."""
        n = len(self.roots) if n_trees is None else n_trees
        return dot(F.slice(self.leaf_values(x), 1, n), _numbers(self.weights[:n]))

    def margins(self, x: Column, lengths: Sequence[int]) -> Column:
        """Array: the weighted sums of the first trees, for each length, in one walk through the trees."""
        weighted = F.zip_with(self.leaf_values(x), _numbers(self.weights), lambda v, w: v * w)
        return F.transform(F.array(weighted), lambda each: F.array(*[
            F.aggregate(F.slice(each, 1, n), F.lit(0.0), lambda s, v: s + v) for n in lengths]))[0]


def export_trees(spark: SparkSession, model) -> Trees:
    """The node table of a fitted tree ensemble, read from its saved form.

    A leaf's value is its prediction, for forests of classifiers the share of
    class 1.  The table is bounded by the ensemble (trees x 2^depth), not by
    the data it was fitted on.
    """
    path = f"{work_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = (spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
            .select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect())
    rows.sort(key=lambda r: (r["treeID"], r["id"]))
    number = {(r["treeID"], r["id"]): i for i, r in enumerate(rows)}
    forest = not hasattr(model, "evaluateEachIteration") and getattr(model, "numClasses", 0) == 2
    split = [r["split"] for r in rows]
    if any(s is not None and s["numCategories"] >= 0 for s in split):
        raise ValueError("categorical splits can't be compiled")
    inner = [r["leftChild"] >= 0 for r in rows]

    def child(r, name: str) -> int:
        return number[r["treeID"], r[name]] if r[name] >= 0 else -1

    def value(r) -> float:
        if not forest:
            return float(r["prediction"])
        total = sum(r["impurityStats"])
        return r["impurityStats"][1] / total if total else 0.0

    return Trees(roots=[number[t, 0] for t in sorted({r["treeID"] for r in rows})], weights=[float(w) for w in model.treeWeights],
                 feature=[s["featureIndex"] if i else 0 for s, i in zip(split, inner, strict=True)],
                 threshold=[float(s["leftCategoriesOrThreshold"][0]) if i else 0.0 for s, i in zip(split, inner, strict=True)],
                 left=[child(r, "leftChild") for r in rows], right=[child(r, "rightChild") for r in rows],
                 value=[value(r) for r in rows], depth=max((t.depth for t in model.trees), default=0))


# ---------------------------------------------------------------- perceptron
def perceptron_layers(layers: Sequence[int], weights: Sequence[float]) -> list[tuple[list[list[float]], list[float]]]:
    """(one row of weights for each unit, biases) of each layer; MLlib keeps a layer's matrix by columns, then the biases."""
    found, at = [], 0
    for n_in, n_out in zip(layers[:-1], layers[1:], strict=True):
        matrix = [[float(weights[at + i * n_out + o]) for i in range(n_in)] for o in range(n_out)]
        at += n_in * n_out
        found.append((matrix, [float(w) for w in weights[at:at + n_out]]))
        at += n_out
    return found


def perceptron(layers: Sequence[int], weights: Sequence[float], x: Column) -> Column:
    """Array of class probabilities: sigmoid units, softmax output."""
    compiled = perceptron_layers(layers, weights)
    for k, (matrix, bias) in enumerate(compiled):
        z = _affine(_rows_of(matrix), _numbers(bias), x)
        x = F.transform(z, sigmoid) if k + 1 < len(compiled) else _softmax(z)
    return x


def _affine(matrix: Column, bias: Column, x: Column) -> Column:
    return F.zip_with(matrix, bias, lambda row, b: dot(row, x) + b)


def _softmax(z: Column) -> Column:
    shifted = F.transform(F.array(z), lambda v: F.transform(v, lambda e: F.exp(e - F.array_max(v))))[0]
    return F.transform(F.array(shifted), lambda v: F.transform(v, lambda e: e / F.aggregate(v, F.lit(0.0), lambda s, t: s + t)))[0]


# ---------------------------------------------------------------- any model
def compile_model(spark: SparkSession, model, features_col: str | None = None) -> Column:
    """What a fitted model says of a row: probability of class 1 of a binary
    classifier, mean of a regression with log or identity link."""
    x = features_array(features_col or model.getFeaturesCol())
    kind = type(model).__name__
    if kind == "LogisticRegressionModel":
        return sigmoid(linear(model.coefficients.toArray().tolist(), model.intercept, x))
    if kind == "GeneralizedLinearRegressionModel":
        eta = linear(model.coefficients.toArray().tolist(), model.intercept, x)
        return F.exp(eta) if model.getLink() == "log" else eta
    if kind == "GBTClassificationModel":
        return sigmoid(2 * export_trees(spark, model).margin(x))
    if kind == "RandomForestClassificationModel":
        trees = export_trees(spark, model)
        return trees.margin(x) / F.lit(float(len(trees.roots)))
    if kind == "MultilayerPerceptronClassificationModel":
        return perceptron(model.getLayers(), model.weights.toArray().tolist(), x)[1]
    raise ValueError(f"{kind} can't be compiled")
