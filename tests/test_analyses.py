"""The end-to-end analyses from files, on small inputs written from the driver tables."""
import os
import tempfile

from pyspark.sql import functions as F

from quarry.plans import analyses
from quarry.sources import datasets, standins
from small_data import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="quarry-an-")


def test_web_logs_from_gzip(spark):
    path = os.path.join(_tmp(), "log")
    standins.log_lines(spark, SF_SMALL).coalesce(1).write.option("compression", "gzip").text(path)
    out = analyses.web_logs(spark, path, rank_name="uni1", rank_class="UK")
    try:
        assert out["class_counts"].count() == 3
        assert out["org_rank"].count() == 1
        assert out["busiest_grid"].count() == 3 * 744
    finally:
        out["cube"].unpersist()


def test_wide_and_scaling_from_csv(spark):
    base = _tmp()
    wb = standins.wide_binary(spark, SF_SMALL).drop("vec_id")
    wb.write.csv(os.path.join(base, "train"))
    wb.limit(100).write.csv(os.path.join(base, "test"))
    res = analyses.wide_tuning(spark, os.path.join(base, "train"), os.path.join(base, "test"), fraction=0.5,
                               grids={"rf": {"numTrees": [5], "maxDepth": [3]}})
    assert res["sample_share"].first().n_sample == sum(
        r["count"] for r in res["class_distribution"].collect() if r["part"] == "sample")
    assert res["n_test"].first()[0] == 100
    assert res["best"].first().params == '{"numTrees":5,"maxDepth":3}'
    assert res["test_report"].first().n == 100
    long, wide = analyses.sample_size_scaling(spark, os.path.join(base, "train"), os.path.join(base, "test"),
                                              fractions=[0.5], n_features=64)
    assert long.count() == 3


def test_recommender_from_csv(spark):
    base = _tmp()
    standins.ratings(spark, SF_SMALL).withColumn("timestamp", F.lit(0).cast("long")) \
        .write.option("header", "true").csv(os.path.join(base, "ratings"))
    standins.relevance_scores(spark, SF_SMALL).withColumn("relevance", F.col("relevance").cast("double")) \
        .write.option("header", "true").csv(os.path.join(base, "scores"))
    standins.tag_dictionary(spark, SF_SMALL).write.option("header", "true").csv(os.path.join(base, "tags"))
    res = analyses.recommender(spark, os.path.join(base, "ratings"), os.path.join(base, "scores"),
                               os.path.join(base, "tags"), k=2, n_clusters_k=3, threshold=0.05)
    assert res["summary"].count() == 3
    assert {r.fold for r in res["profile"].collect()} == {0, 1}
    assert res["top_clusters"].groupBy("fold").count().where("count > 3").isEmpty()


def test_encounter_glms_from_csv(spark):
    path = os.path.join(_tmp(), "enc.csv")
    meds = datasets.MEDICATION_COLUMNS
    levels = ["No", "Steady", "Up", "Down"]
    with open(path, "w") as f:
        f.write(",".join(["encounter_id", *meds, "time_in_hospital", "readmitted"]) + "\n")
        for i in range(400):
            vals = [levels[(i * (j + 3)) % 4] for j in range(len(meds))]
            f.write(",".join([str(i), *vals, str(1 + i % 9), "NO" if i % 3 else "<30"]) + "\n")
    res = analyses.encounter_glms(spark, path, reg_params=[0.01, 1.0], en_params=[0.0, 1.0], parallelism=2)
    assert res["curves"].count() == 2 + 2 + 4
    assert res["en_matrix"].count() == 2
    assert {r.model for r in res["test_report"].collect()} == {"poisson", "logistic_l2", "logistic_en"}


def test_command_line_weblog(spark):
    from quarry.__main__ import main
    base = _tmp()
    log = os.path.join(base, "log")
    standins.log_lines(spark, SF_SMALL).coalesce(1).write.option("compression", "gzip").text(log)
    main(["weblog", "--log", log, "--rank-name", "uni1", "--out", os.path.join(base, "out")])
    assert spark.read.parquet(os.path.join(base, "out", "class_counts")).count() == 3
    assert spark.read.parquet(os.path.join(base, "out", "busiest_grid")).count() == 3 * 744


def test_command_line_recommender_and_scaling(spark):
    from quarry.__main__ import main
    base = _tmp()
    standins.ratings(spark, SF_SMALL).withColumn("timestamp", F.lit(0).cast("long")) \
        .write.option("header", "true").csv(os.path.join(base, "ratings"))
    standins.relevance_scores(spark, SF_SMALL).withColumn("relevance", F.col("relevance").cast("double")) \
        .write.option("header", "true").csv(os.path.join(base, "scores"))
    standins.tag_dictionary(spark, SF_SMALL).write.option("header", "true").csv(os.path.join(base, "tags"))
    main(["recommender", "--ratings", os.path.join(base, "ratings"), "--scores", os.path.join(base, "scores"),
          "--tags", os.path.join(base, "tags"), "--out", os.path.join(base, "q4")])
    assert spark.read.parquet(os.path.join(base, "q4", "summary")).count() == 3
    assert spark.read.parquet(os.path.join(base, "q4", "top_clusters")).count() == 4 * 3
    wb = standins.wide_binary(spark, SF_SMALL).drop("vec_id")
    wb.write.csv(os.path.join(base, "train"))
    wb.limit(50).write.csv(os.path.join(base, "test"))
    from quarry.plans import analyses as A
    long, _ = A.sample_size_scaling(spark, os.path.join(base, "train"), os.path.join(base, "test"),
                                    fractions=[0.5], results_path=os.path.join(base, "q3b"), n_features=64)
    assert spark.read.parquet(os.path.join(base, "q3b")).count() == 1
