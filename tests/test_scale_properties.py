"""Plan-level properties the design relies on at scale."""
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.plans import weblog
from small_data import SF_SMALL


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_host_is_exact_and_combined_map_side(spark):
    n = 30000
    hot = 'hot.big.edu - - [02/Jul/1995:10:00:00 -0400] "GET / HTTP/1.0" 200 1'
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot))
         .otherwise(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".u"), (F.col("id") % 50).cast("string"),
                             F.lit('.ac.uk - - [03/Jul/1995:11:00:00 -0400] "GET / HTTP/1.0" 200 1'))).alias("value"))
    cube = weblog.request_cube(lines)
    counts = {r.country_code: r["count"] for r in weblog.class_counts(cube).collect()}
    assert counts == {"US": n // 3, "UK": n - n // 3, "AUS": 0}
    top = weblog.org_top(cube, 3)
    plan = _plan(top)
    assert "partial_count" in plan                        # map-side combine before the shuffle
    assert "WindowGroupLimit" in plan                     # top-N bounded before its shuffle
    first = {r.country_code: (r.institution, r["count"]) for r in top.collect() if r["rank"] == 1}
    assert first["US"] == ("big", n // 3)


def test_each_weblog_query_scans_the_log_once(spark):
    q = entry.queries()
    for name in ["class_counts", "org_distinct", "org_topn", "org_rank", "org_share", "hour_grid"]:
        plan = _plan(q[name](spark, SF_SMALL))
        assert plan.count("FileScan") == 1, name


def test_scans_read_only_needed_columns(spark):
    q = entry.queries()
    plan = _plan(q["class_counts"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "value" not in schema
    plan = _plan(q["topk"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(f.split(":")[0] for f in schema.split(",")) == {"o_orderkey", "o_custkey", "o_totalprice"}


def test_auc_has_no_unpartitioned_window_over_rows(spark):
    plan = _plan(entry.queries()["auc_exact"](spark, SF_SMALL))
    assert "rangepartitioning" in plan
    for w in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert w.strip() != ""                            # every window is partitioned
