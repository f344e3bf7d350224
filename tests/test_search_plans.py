"""Grid searches leave scores, not models, in their plan."""
from quarry.operators import features, models, splits, tuning
from quarry.session import with_checkpoints
from quarry.sources import standins
from small_data import SF_SMALL


def test_plan_of_a_search_holds_no_model(spark):
    wide = standins.wide_binary(with_checkpoints(spark), SF_SMALL)
    rows = features.assembler(["_c0", "_c1", "_c2"], "features").transform(wide).selectExpr(
        "vec_id", "features", "cast(label > 0 as double) as label").persist()
    train, valid = splits.hash_split(rows, "vec_id", 0.5)
    est = models.gbt("features", "label")
    grid = tuning.param_grid(est, {"maxDepth": [2, 3], "maxIter": [1, 3]})
    scores = tuning.search_folds(est, grid, [(train, valid), (valid, train)])
    assert scores.count() == len(grid) * rows.count()
    assert len(scores._jdf.queryExecution().optimizedPlan().toString()) < 1000 * len(grid)
    assert "aggregate(" not in scores._jdf.queryExecution().optimizedPlan().toString()
