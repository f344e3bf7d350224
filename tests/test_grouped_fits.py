"""Fits and metrics on distinct rows and their numbers, against the same on all rows."""
import pytest
from pyspark.sql import functions as F

from quarry.operators import features, metrics, models
from quarry.plans import tabular
from quarry.sources import standins
from small_data import SF_SMALL

CATS = ["l_returnflag", "p_brand"]


@pytest.fixture(scope="module")
def rows(spark):
    enc = tabular.prepare_binary_label(standins.encounters(spark, SF_SMALL), "l_linestatus", "F", "flag")
    enc = enc.withColumn("flag", F.when(F.col("l_orderkey") % 7 == 0, 1 - F.col("flag")).otherwise(F.col("flag")))
    return enc.select(*CATS, "flag", "l_quantity").persist()


def _encoded(rows):
    model = features.categorical_pipeline(CATS, "features").fit(rows)
    groups = tabular.grouped_rows(rows, [*CATS, "flag"], "l_quantity")
    return model.transform(rows).persist(), model.transform(groups).persist()


def test_grouped_logistic_is_the_fit_of_all_rows(rows):
    every, groups = _encoded(rows)
    assert groups.count() < every.count() / 2
    assert groups.agg(F.sum(tabular.N_ROWS)).first()[0] == every.count()
    for reg, mixing in ((0.05, 0.0), (0.02, 0.5), (0.02, 1.0)):
        whole = models.logistic("features", "flag", reg, mixing).setTol(1e-10).fit(every)
        few = models.grouped_logistic("features", "flag", tabular.N_ROWS, reg, mixing).setTol(1e-10).fit(groups)
        assert abs(whole.intercept - few.intercept) < 1e-5
        assert max(abs(whole.coefficients.toArray() - few.coefficients.toArray())) < 1e-5
        scored = few.transform(groups)
        exact = metrics.accuracy(whole.transform(every), "flag").first()
        assert metrics.accuracy(scored, "flag", n_col=tabular.N_ROWS).first() == exact
        assert metrics.accuracy_evaluator("flag", n_col=tabular.N_ROWS).evaluate(scored) == pytest.approx(exact["accuracy"], abs=1e-12)


def test_grouped_poisson_is_the_fit_of_all_rows(rows):
    every, groups = _encoded(rows)
    whole = models.poisson_glm("features", "l_quantity", 0.1).fit(every)
    few = models.poisson_glm("features", "l_quantity", 0.1, weight_col=tabular.N_ROWS).fit(groups)
    assert max(abs(whole.coefficients.toArray() - few.coefficients.toArray())) < 1e-6
    rmse = metrics.rmse_evaluator("l_quantity").evaluate(whole.transform(every))
    found = metrics.GroupedRmse("l_quantity", tabular.N_ROWS, tabular.SQUARES).evaluate(few.transform(groups))
    assert found == pytest.approx(rmse, rel=1e-8)


def test_labels_that_no_count_model_takes_still_fail(spark, rows):
    for bad in (-1.0, None):
        odd = rows.withColumn("l_quantity", F.when(F.col("l_quantity") == 1, F.lit(bad)).otherwise(F.col("l_quantity")))
        _, groups = _encoded(odd)
        with pytest.raises(Exception):
            models.poisson_glm("features", "l_quantity", weight_col=tabular.N_ROWS).fit(groups)


def test_searches_read_combinations_not_rows(spark, monkeypatch):
    """A table twice as long has the same combinations, so the fits see as many rows."""
    seen = []
    search = tabular.G.cross_validate
    monkeypatch.setattr(tabular.G, "cross_validate", lambda est, grid, ev, data, *a: seen.append(data.count()) or search(est, grid, ev, data, *a))
    enc = tabular.prepare_binary_label(standins.encounters(spark, SF_SMALL), "l_linestatus", "F", "flag")
    train, test = tabular.split_encounters(enc, ["l_orderkey", "l_linenumber"])
    found = []
    for t in (train, train.unionByName(train)):
        out = tabular.tune_glms(t, test, CATS, "l_quantity", "flag", [0.01], [0.0, 1.0], id_cols=["l_orderkey", "l_linenumber"])
        found.append({(r.model, r.metric): r.value for r in out["test_report"].collect()})
        counts = {(r.split, r.flag): r["count"] for r in out["split_distribution"].collect()}
        assert sum(n for (split, _), n in counts.items() if split == "train") == t.count()
    assert seen[0] == seen[2] < train.count() / 2
    assert found[0] == pytest.approx(found[1], rel=1e-3)


def test_score_sums_of_groups_are_those_of_all_rows(rows):
    from quarry.operators import conditions
    every, groups = _encoded(rows)
    whole = {r.j: r for r in conditions.score_sums(every, "features", 0.3 - F.col("flag")).collect()}
    few = {r.j: r for r in conditions.score_sums(groups, "features", 0.3 - F.col("flag"), tabular.N_ROWS).collect()}
    assert whole.keys() == few.keys()
    for j, r in whole.items():
        assert (few[j].score, few[j].std) == pytest.approx((r.score, r.std), rel=1e-9)


def test_fold_metrics_of_the_counts_read_groups(spark, monkeypatch):
    from quarry import registry
    seen, search = [], registry.tuning.cross_validate
    monkeypatch.setattr(registry.tuning, "cross_validate",
                        lambda est, grid, ev, data, *a, **k: seen.append(data.count()) or search(est, grid, ev, data, *a, **k))
    assert registry.poisson_fold_metrics(spark, SF_SMALL).count() == 1
    brands = standins.encounters(spark, SF_SMALL).select("p_brand").distinct().count()
    assert seen[0] <= 3 * brands


def test_index_of_counted_rows_is_that_of_all_rows(spark):
    """No pass over the rows for the indexer; ties go by value, NULL has no index."""
    from quarry.operators import features
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("c", 1), ("b", 2), ("z", 9), (None, 1), ("a", 3), ("é", 4), ("\U0001f600", 5), ("～", 6)],
                                 "s string, k int")
    counted = rows.groupBy("s", "k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    for how in ("error", "keep"):
        want = features.string_indexer(["s", "k"], how).fit(rows)
        got = features.counted_index(counted, ["s", "k"], "n", how)
        assert [list(m.labels) for m in got] == [list(x) for x in want.labelsArray]
        some = rows.where("s is not null")
        assert sorted(got[1].transform(got[0].transform(some)).collect()) == sorted(want.transform(some).collect())
