"""Model expressions, optimality conditions, shared grid fits, the distributed index and file round trips."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import checks
from quarry.operators import compiled, conditions, features, metrics, models, tuning
from quarry.sources import standins
from quarry.sources.tables import append_results, read_results, scan_csv
from small_data import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    return checks._wide(spark, SF_SMALL).cache()


def test_expression_equals_transform_row_for_row(spark, rows):
    for est in (models.random_forest("features", "label", numTrees=4, maxDepth=6),
                models.gbt("features", "label", maxIter=4, maxDepth=4),
                models.mlp("features", "label", [64, 5, 3, 2], maxIter=8, blockSize=32),
                models.logistic("features", "label", 0.02, 0.3)):
        model = est.fit(rows)
        both = model.transform(rows).select(vector_to_array("probability")[1].alias("p"), compiled.compile_model(spark, model).alias("q"))
        assert both.where("abs(p - q) > 1e-9 or q is null").count() == 0
    with pytest.raises(ValueError):
        compiled.compile_model(spark, models.kmeans(2).fit(rows), "features")


def test_boosted_grid_equals_single_fits(spark, rows):
    est = models.gbt("features", "label", stepSize=0.4)
    grid = tuning.param_grid(est, {"maxDepth": [3, 9, 12], "maxIter": [1, 3, 5]})
    train, valid = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    fits = tuning.fit_boosted(est, {}, tuning.boosting_groups(est, grid)[0][1], train)
    assert len(fits) < 4 and sorted(p.index for _, done in fits for p in done) == list(range(9))
    shared = metrics.auc_exact(tuning.search_folds(est, grid, [(train, valid)]), "label", "score", "grid_index")
    got = {r["grid_index"]: r["auc"] for r in shared.collect()}
    for i, params in enumerate(grid):
        assert got[i] == pytest.approx(metrics.ExactAuc("label").evaluate(est.fit(train, params).transform(valid)), abs=1e-12)


def test_served_points():
    points = [tuning.Point(0, 10, 5), tuning.Point(1, 10, 8), tuning.Point(2, 50, 8), tuning.Point(3, 50, 10)]
    assert [p.index for p in tuning.served(points, 50, 10, [7] * 20 + [9] * 30)] == [1, 3]
    assert [p.index for p in tuning.served(points, 50, 10, [4] * 50)] == [0, 1, 2, 3]


def test_exact_auc_selects_beyond_bins(spark):
    # scores that differ by less than one bin of 1,000 decide
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("label"),
                                  (F.col("id") * 1e-9 + (F.col("id") % 2) * 1e-10).alias("rawPrediction"))
    assert metrics.ExactAuc("label").evaluate(df) == pytest.approx(0.50025, abs=1e-6)
    one = df.where("label = 1")
    assert metrics.ExactAuc("label").isLargerBetter() and str(metrics.ExactAuc("label").evaluate(one)) == "nan"


def test_conditions_tell_wrong_models(spark, rows):
    model = models.logistic("features", "label", 0.01, 0.5).setTol(1e-9).fit(rows)
    residual = compiled.compile_model(spark, model) - F.col("label")
    assert conditions.elastic_net_violations(rows, model, residual, 0.01, 0.5).first()["violations"] == 0
    for reg, mixing in ((0.03, 0.5), (0.01, 0.1)):
        assert conditions.elastic_net_violations(rows, model, residual, reg, mixing).first()["violations"] > 0
    ratings = standins.ratings(spark, SF_SMALL)
    als = models.als(rank=3, maxIter=2, regParam=0.1).fit(ratings)
    good = conditions.als_residuals(ratings, als.userFactors, als.itemFactors, 3, 0.1)
    wrong = conditions.als_residuals(ratings, als.userFactors, als.itemFactors, 3, 0.3)
    assert good.where("residual > 1e-3").count() == 0 < wrong.where("residual > 1e-3").count()
    points = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [10.0, 0.0])], "cluster int, features array<double>")
    assert tuple(conditions.centre_mismatches(points, [[1.0, 0.0], [10.0, 0.0]], "features", "cluster").first()) == (3, 0, 0)
    assert tuple(conditions.centre_mismatches(points, [[1.0, 0.0], [2.5, 0.0]], "features", "cluster").first()) == (3, 1, 1)


def test_distributed_index_equals_string_indexer(spark):
    values = ["b", "a", "c", "a", "b", "d", "", "zz", "zz", "zz", "é", "B"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    want = features.string_indexer(["v"]).fit(df).transform(df).select("v", F.col("v_index").cast("long")).collect()
    index = features.DistributedIndex.fit(df, "v")
    assert sorted(map(tuple, index.transform(df).collect())) == sorted(map(tuple, want))
    new = spark.createDataFrame([("a",), ("new",), (None,)], "v string")
    assert {r["v"]: r["v_index"] for r in index.transform(new, handle_invalid="keep").collect()} == {"a": 1, "new": 8, None: 8}
    assert [r["v"] for r in index.transform(new, handle_invalid="skip").collect()] == ["a"]
    with pytest.raises(Exception, match="unseen value"):
        index.transform(new).collect()
    empty = features.DistributedIndex.fit(df.where("false"), "v")
    assert empty.transform(df, handle_invalid="keep").where("v_index = 0").count() == len(values)


def test_scan_sets_bad_records_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id;name;x\n1;one;1.5\n2;two\n3;three;3.5;more\n4;four;word\n5;"a;b";5.5\n6;;\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    scan = scan_csv(spark, str(tmp_path / "in"), schema, header=True, sep=";")
    assert sorted(tuple(r) for r in scan.parsed.select("id", "x").collect()) == [(1, 1.5), (5, 5.5), (6, None)]
    assert {r["record"]: r["reason"] for r in scan.quarantined.collect()} == {
        "2;two": "short", "3;three;3.5;more": "long", "4;four;word": "type"}
    assert scan.parsed.columns == ["id", "name", "x"]


def test_a_rerun_appends_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "results")
    for run, sizes in (("r1", [0.2]), ("r2", [0.4, 0.6]), ("r1", [0.2])):
        append_results(spark.createDataFrame([(s, 1) for s in sizes], "sample_size double, sample_count int"), path, run_id=run)
    assert [r["sample_size"] for r in read_results(spark, path).collect()] == [0.2, 0.4, 0.6]


def test_als_blocks_follow_the_ratings(spark, monkeypatch):
    """What a task holds while it builds a block doesn't grow with the ratings; the conditions hold all the same."""
    from quarry import checks
    made, als = [], models.als
    monkeypatch.setattr(models, "als", lambda **how: made.append(als(**how)) or made[-1])
    assert checks.kmeans_conditions(spark, SF_SMALL).first()["not_nearest"] == 0
    monkeypatch.setattr(models, "RATINGS_PER_BLOCK", 400, raising=False)
    got = checks.kmeans_conditions(spark, SF_SMALL).first()
    assert got["not_nearest"] == got["centres_off"] == 0 and got["n"] > 0
    assert checks.als_normal_equations(spark, SF_SMALL).first()["mismatches"] == 0
    first, second, third = ((e.getNumUserBlocks(), e.getNumItemBlocks()) for e in made)
    assert first == (10, 10) and second == third and second[0] == second[1] > 10
