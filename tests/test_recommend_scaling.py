import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import recommend, scaling
from quarry.sources import standins
from small_data import SF_SMALL


def test_cluster_profile_matches_brute_force(spark):
    clusters = standins.fixed_clusters(spark, SF_SMALL, 7)
    rel = standins.relevance_scores(spark, SF_SMALL)
    tags = standins.tag_dictionary(spark, SF_SMALL)
    got = recommend.cluster_profile(clusters, rel, tags, n_clusters=2, n_tags=3, threshold=0.05).toPandas()
    c, r, t = clusters.toPandas(), rel.toPandas(), tags.toPandas()
    r["relevance"] = r["relevance"].astype(float)
    sizes = c.groupby("cluster").size().reset_index(name="n").sort_values(["n", "cluster"], ascending=[False, True])
    top = list(sizes.cluster[:2])
    j = c[c.cluster.isin(top)].rename(columns={"id": "movieId"}).merge(r, on="movieId")
    agg = j.groupby(["cluster", "tagId"]).agg(avg=("relevance", "mean"),
                                              n=("relevance", lambda s: int((s > 0.05).sum()))).reset_index()
    agg = agg.sort_values(["cluster", "avg", "tagId"], ascending=[True, False, True]).groupby("cluster").head(3)
    exp = agg.merge(t, on="tagId")
    assert sorted(zip(got.cluster, got.tagId, got.n_items)) == sorted(zip(exp.cluster, exp.tagId, exp.n))
    assert list(got["rank"][:3]) == [1, 2, 3]


def test_als_cv_and_clusters_small(spark):
    ratings = standins.ratings(spark, SF_SMALL)
    metrics, factors = recommend.als_cv(ratings, configs=[{"rank": 4, "maxIter": 3}], k=2, keep_item_factors=0)
    m = metrics.collect()
    assert len(m) == 2 and all(r.rmse > 0 and r.mae > 0 for r in m)
    summary = recommend.als_summary(metrics, 2).first()
    assert summary.rmse_mean > 0
    cl = recommend.factor_clusters(factors[0], k=3)
    assert cl.select("cluster").distinct().count() <= 3


def test_scaling_study_appends_and_reports(spark):
    wb = standins.wide_binary(spark, SF_SMALL)
    from quarry.operators.splits import hash_split
    train, test = hash_split(wb, "vec_id", 0.8)
    feats = [f"_c{i}" for i in range(64)]
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-test-"), "results")
    for _ in range(2):   # two runs append
        long, wide = scaling.scaling_study(train, test, feats, "label", "vec_id", fractions=[0.5, 1.0],
                                           families=["rf"], params={"rf": {"numTrees": 5, "maxDepth": 3}},
                                           results_path=out)
    assert long.count() == 2
    assert set(wide.columns) >= {"sample_size", "sample_count", "rf_accuracy", "rf_auc", "rf_time"}
    rep = scaling.scaling_report(spark, out, ["rf"]).collect()
    assert len(rep) == 4
    assert [r.sample_size_percent for r in rep] == sorted(r.sample_size_percent for r in rep)
    n50 = {r.sample_count for r in rep if r.sample_size_percent == 50.0}
    assert len(n50) == 1                 # deterministic sample: same rows on both runs


def test_als_files_go_with_each_iteration_and_fit(spark, monkeypatch):
    from quarry.operators import models
    from quarry.session import with_checkpoints
    assert models.als().getCheckpointInterval() == 1
    gone = []
    monkeypatch.setattr(recommend, "let_go", gone.append)
    ratings = standins.ratings(with_checkpoints(spark), SF_SMALL)
    metrics, _ = recommend.als_cv(ratings, configs=[{"rank": 4, "maxIter": 3}], k=2)
    assert len(gone) >= 2  # after each fit
    seldom = recommend.als_cv(ratings, configs=[{"rank": 4, "maxIter": 3, "checkpoint_interval": 10}], k=2)[0]
    rare = {r.fold: r.rmse for r in seldom.collect()}
    assert {r.fold: r.rmse for r in metrics.collect()} == rare


def test_dot_products_join_the_ratings_once(spark):
    from quarry import registry
    from quarry.session import with_checkpoints
    found = registry.als_dot_products(with_checkpoints(spark), SF_SMALL)
    assert "lineitem" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["mismatches"] == 0


def test_als_scores_after_the_files_of_its_fit_are_gone(spark, monkeypatch):
    """One fit at a time; a model is scored from its saved factors, which go afterwards."""
    from quarry.operators.tuning import run_concurrently
    from quarry.session import checkpoint_dir, work_folder
    seen, together = [], []
    monkeypatch.setattr(recommend, "valid_predictions", lambda df: seen.append(df.inputFiles()) or df)
    monkeypatch.setattr(recommend, "run_concurrently", lambda jobs, n: together.append(n) or run_concurrently(jobs, n))
    _, factors = recommend.als_cv(standins.ratings(spark, SF_SMALL), configs=[{"rank": 2, "maxIter": 1}], k=2, keep_item_factors=0)
    assert checkpoint_dir(spark) and together == [1]
    assert len(seen) == 2 and all(any("/model_" in f for f in files) for files in seen)
    folder = work_folder(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("model_")]
    assert factors[1].count() > 0


def test_als_fits_of_two_configurations_run_side_by_side(spark, monkeypatch):
    """Never two of the costliest; every fit once, the metrics of fits one by one."""
    from quarry.operators import models
    from quarry.operators.tuning import run_concurrently
    first, second = recommend.fit_lanes(models.ALS_CONFIGS, 4, 2)
    assert {i for _, i in first} == {2} and sorted(first + second) == [(fold, i) for fold in range(4) for i in range(3)]
    assert [len(lane) for lane in recommend.fit_lanes(models.ALS_CONFIGS, 4, 1)] == [12]
    together = []
    monkeypatch.setattr(recommend, "run_concurrently", lambda jobs, n: together.append(n) or run_concurrently(jobs, n))
    configs = [{"rank": 2, "maxIter": 1}, {"rank": 3, "maxIter": 1}]
    ratings = standins.ratings(spark, SF_SMALL)
    found = [[(r.model, r.fold, r.n, round(r.rmse, 6)) for r in recommend.als_cv(ratings, configs=configs, k=2, **how)[0].collect()]
             for how in ({}, {"parallelism": 1})]
    assert together == [2, 1] and found[0] == found[1] and len(found[0]) == 4
