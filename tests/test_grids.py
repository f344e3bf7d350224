import numpy as np

from quarry.operators.grids import dense_grid, fold_summary, metric_matrix


def test_dense_grid_fills_zeros_and_keeps_total(spark):
    counts = spark.createDataFrame([("u", 1, 0, 4), ("u", 31, 23, 2), ("v", 2, 5, 1), ("u", 32, 1, 9)],
                                   "g string, day int, hour int, count long")
    observed = counts.filter("day between 1 and 31 and hour between 0 and 23")
    grid = dense_grid(observed, "g", "day", range(1, 32), "hour", range(0, 24)).collect()
    assert len(grid) == 2 * 744
    assert sum(r["count"] for r in grid if r.g == "u") == 6
    cell = {(r.g, r.day, r.hour): r["count"] for r in grid}
    assert cell[("u", 1, 0)] == 4 and cell[("u", 31, 23)] == 2 and cell[("u", 15, 12)] == 0


def test_fold_summary_population_std(spark):
    vals = [0.8, 0.9, 1.0, 1.3]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(vals)], "model string, fold int, rmse double")
    (r,) = fold_summary(df, "model", "fold", "rmse", [0, 1, 2, 3]).collect()
    assert abs(r.rmse_mean - np.mean(vals)) < 1e-12
    assert abs(r.rmse_std - np.std(vals)) < 1e-12     # ddof 0
    assert r.rmse_fold3 == 1.3


def test_metric_matrix(spark):
    df = spark.createDataFrame([(a, b, a * 10 + b) for a in (0.1, 1.0) for b in (0.0, 0.5)],
                               "regParam double, en double, mean_metric double")
    rows = {r.regParam: r for r in metric_matrix(df, "regParam", "en", "mean_metric", [0.0, 0.5]).collect()}
    assert rows[1.0]["en_0.5"] == 10.5
