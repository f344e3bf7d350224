import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import features as E
from quarry.operators import models as M
from quarry.operators import tuning as G
from quarry.operators.metrics import accuracy_evaluator


def test_string_indexer_frequency_then_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", "b", "a", "d"]], "cat string")
    model = E.string_indexer(["cat"]).fit(df)
    idx = {r.cat: r.cat_index for r in model.transform(df).distinct().collect()}
    assert idx == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}


def test_unseen_category_error_or_keep(spark):
    train = spark.createDataFrame([("a",), ("b",)], "cat string")
    test = spark.createDataFrame([("z",)], "cat string")
    with pytest.raises(Exception):
        E.string_indexer(["cat"]).fit(train).transform(test).collect()
    kept = E.string_indexer(["cat"], handle_invalid="keep").fit(train).transform(test).first()
    assert kept.cat_index == 2.0


def test_one_hot_keeps_single_level(spark):
    df = spark.createDataFrame([("x",), ("x",)], "cat string")
    out = E.categorical_pipeline(["cat"], "f").fit(df).transform(df)
    assert out.select(vector_to_array("f").alias("a")).first().a == [1.0]


def test_standardizer_uses_sample_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    asm = E.assembler(["x"], "v").transform(df)
    z = [r.a[0] for r in E.standardizer("v", "z").fit(asm).transform(asm)
         .select(vector_to_array("z").alias("a")).collect()]
    assert sorted(z) == pytest.approx([-0.7071067811865475, 0.7071067811865475])


def test_param_grid_last_varies_fastest(spark):
    est = M.logistic("f", "y")
    grid = G.param_grid(est, {"regParam": [0.1, 1.0], "elasticNetParam": [0.0, 0.5]})
    seq = [(pm[est.regParam], pm[est.elasticNetParam]) for pm in grid]
    assert seq == [(0.1, 0.0), (0.1, 0.5), (1.0, 0.0), (1.0, 0.5)]


def test_cv_curve_and_learnable_signal(spark):
    rows = [(i, "up" if i % 2 else "down", float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cat string, y double")
    pipe = E.categorical_pipeline(["cat"], "features")
    data = pipe.fit(df).transform(df)
    est = M.logistic("features", "y")
    grid = G.param_grid(est, {"regParam": [0.001, 0.1]})
    cvm = G.cross_validate(est, grid, accuracy_evaluator("y"), data, folds=3)
    curve = G.validation_curve(spark, cvm, grid)
    assert curve.columns == ["grid_index", "regParam", "mean_metric", "std_metric"]
    assert curve.count() == 2
    best = G.best_point(curve, True).first()
    assert best.mean_metric > 0.9       # beats the 0.5 majority baseline
    assert G.best_params(spark, cvm, ["regParam"]).first().regParam == best.regParam


def test_hash_folds_make_cv_reproducible_across_partitionings(spark):
    from quarry.operators.splits import with_fold
    rows = [(i, "up" if (i * 7) % 5 < 3 else "down", float((i * 7) % 5 < 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, cat string, y double")
    data = E.categorical_pipeline(["cat"], "features").fit(df).transform(df)
    data = with_fold(data, "id", 3, "cv_fold")
    est = M.logistic("features", "y")
    grid = G.param_grid(est, {"regParam": [0.01, 1.0]})
    a = G.cross_validate(est, grid, accuracy_evaluator("y"), data, folds=3, fold_col="cv_fold").avgMetrics
    b = G.cross_validate(est, grid, accuracy_evaluator("y"), data.repartition(7), folds=3,
                         fold_col="cv_fold").avgMetrics
    assert a == pytest.approx(b, abs=1e-12)


def test_hyphenated_categorical_names(spark):
    df = spark.createDataFrame([("No", "Up"), ("Steady", "No"), ("No", "No")], "`glyburide-metformin` string, `insulin` string")
    out = E.categorical_pipeline(["glyburide-metformin", "insulin"], "f").fit(df).transform(df)
    widths = {len(r.a) for r in out.select(vector_to_array("f").alias("a")).collect()}
    assert widths == {4}


def test_als_blocks_never_follow_the_cluster(spark):
    est = M.als()
    assert est.getNumUserBlocks() == est.getNumItemBlocks() == 10
    assert M.als(blocks=3).getNumItemBlocks() == 3


def test_best_point_uses_unrounded_means(spark):
    # rounded to 4 places both read 0.5506; the second is truly better
    curve = spark.createDataFrame([(0, 0.001, 0.55061, 0.01), (1, 0.01, 0.55064, 0.01), (2, 0.1, 0.5401, 0.01)],
                                  "grid_index int, regParam double, mean_metric double, std_metric double")
    assert G.best_point(curve, True).first().grid_index == 1
    shown = {r.grid_index: r.mean_metric for r in G.rounded(curve).collect()}
    assert shown[0] == shown[1] == 0.5506


def test_encoded_width_is_the_sum_of_levels(spark):
    cats = [f"c{j}" for j in range(23)]
    train = spark.createDataFrame([tuple(f"v{i % (2 + j % 4)}" for j in range(23)) for i in range(60)],
                                  ", ".join(f"{c} string" for c in cats))
    levels = sum(2 + j % 4 for j in range(23))
    for invalid, width in (("error", levels), ("keep", levels + 23)):
        model = E.categorical_pipeline(cats, "x", handle_invalid=invalid).fit(train)
        assert model.transform(train).first().x.size == width
    unseen = train.limit(1).withColumn("c0", F.lit("new"))
    assert model.transform(unseen).first().x.numNonzeros() == 23
