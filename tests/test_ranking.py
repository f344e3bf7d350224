from pyspark.sql import functions as F

from quarry.operators.aggregates import arg_best, distinct_count_per_group
from quarry.operators.ranking import rank_of, share_with_remainder, top_k, top_n_per_group

ROWS = [("g", "a", 5), ("g", "b", 5), ("g", "c", 3), ("g", "d", 3), ("g", "e", 1), ("h", "x", 2)]


def _df(spark):
    return spark.createDataFrame(ROWS, "grp string, key string, count long")


def test_top_n_ties_by_key(spark):
    got = top_n_per_group(_df(spark), "grp", "count", 3, tie_cols=["key"]).orderBy("grp", "rank").collect()
    assert [(r.grp, r.key, r.rank) for r in got] == [("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("h", "x", 1)]


def test_top_n_stable_under_repartition(spark):
    a = top_n_per_group(_df(spark), "grp", "count", 3, tie_cols=["key"]).collect()
    b = top_n_per_group(_df(spark).repartition(7), "grp", "count", 3, tie_cols=["key"]).collect()
    assert sorted(a) == sorted(b)


def test_top_n_plan_uses_window_group_limit(spark):
    plan = top_n_per_group(_df(spark), "grp", "count", 3, tie_cols=["key"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan


def test_rank_of_position_and_sql_rank(spark):
    (r,) = rank_of(_df(spark), "grp", "key", "d").collect()
    assert (r.position, r.rank, r["count"]) == (4, 3, 3)


def test_share_with_remainder_sums_to_total(spark):
    out = share_with_remainder(_df(spark), "grp", "key", 2).collect()
    g = {r.key: (r["count"], r.pct) for r in out if r.grp == "g"}
    assert g["Others"][0] == 3 + 3 + 1
    assert sum(c for c, _ in g.values()) == 17
    assert abs(sum(p for _, p in g.values()) - 100.0) < 1e-9


def test_top_k_global(spark):
    got = top_k(_df(spark), "count", 2, tie_cols=["key"]).collect()
    assert [r.key for r in got] == ["a", "b"]


def test_distinct_count_null_semantics(spark):
    df = spark.createDataFrame([("g", "a"), ("g", None), ("g", "a")], "grp string, v string")
    with_null = distinct_count_per_group(df, "grp", "v", count_null=True).first().n_distinct
    sql = distinct_count_per_group(df, "grp", "v", count_null=False).first().n_distinct
    assert (with_null, sql) == (2, 1)


def test_arg_best_first_on_tie(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, 0.1)], "grid_index int, m double")
    assert arg_best(df, "m", "grid_index", maximize=True).first().grid_index == 1
    assert arg_best(df, "m", "grid_index", maximize=False).first().grid_index == 3
