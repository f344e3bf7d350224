import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.logparse import parse_log
from quarry.operators.inspect import collect_small, preview
from quarry.operators.metrics import accuracy_evaluator, evaluation_table, rmse_evaluator
from quarry.plans import weblog
from quarry.sources import standins
from quarry.sources.tables import (
    positional_schema, read_csv, read_headerless_csv, read_log_text, split_features_label,
)
from small_data import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="quarry-src-")


def test_gzip_log_roundtrip(spark):
    lines = standins.log_lines(spark, SF_SMALL)
    path = os.path.join(_tmp(), "log")
    lines.coalesce(1).write.option("compression", "gzip").text(path)
    back = read_log_text(spark, path, partitions=4)
    assert back.rdd.getNumPartitions() == 4
    a = weblog.class_counts(weblog.request_cube(back)).collect()
    b = weblog.class_counts(weblog.request_cube(lines)).collect()
    assert sorted(a) == sorted(b)


def test_headerless_csv_positional(spark):
    wb = standins.wide_binary(spark, SF_SMALL).drop("vec_id")
    path = os.path.join(_tmp(), "wide")
    wb.write.option("header", "false").csv(path)
    df = read_headerless_csv(spark, path, positional_schema(64))
    feats, label = split_features_label(df.columns)
    assert len(feats) == 64 and label == "_c64"
    assert df.count() == wb.count()
    assert sorted(r[0] for r in df.groupBy(label).count().collect()) == [-1, 1]


def test_headed_csv_declared_schema_and_nulls(spark):
    path = os.path.join(_tmp(), "ratings.csv")
    with open(path, "w") as f:
        f.write("userId,movieId,rating,timestamp\n1,10,4.5,111\n2,NA,3.0,112\n")
    df = read_csv(spark, path, "userId INT, movieId INT, rating FLOAT, timestamp LONG", null_value="NA")
    rows = df.orderBy("userId").collect()
    assert rows[0].rating == 4.5 and rows[1].movieId is None


def test_preview_and_bounded_collect(spark):
    df = spark.range(100)
    assert preview(df, 5).count() == 5
    assert len(collect_small(df, 100)) == 100
    with pytest.raises(ValueError):
        collect_small(df, 99)


def test_evaluation_table(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], "y double, prediction double")
    tbl = evaluation_table(spark, {"m": df}, {"accuracy": accuracy_evaluator("y"), "rmse": rmse_evaluator("y")})
    got = {r.metric: r.value for r in tbl.collect()}
    assert got["accuracy"] == pytest.approx(0.75) and got["rmse"] == pytest.approx(0.5)


def test_stream_matches_batch(spark):
    from quarry.streaming.weblog_stream import class_counts_stream, start_class_counts
    base = _tmp()
    src = os.path.join(base, "src")
    standins.log_lines(spark, SF_SMALL).repartition(3).write.text(src)
    q = start_class_counts(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    streamed = sorted(spark.read.parquet(os.path.join(base, "out")).collect())
    batch = sorted(class_counts_stream(spark.read.text(src)).collect())
    assert streamed == batch and len(batch) == 3


def test_original_dataset_readers(spark):
    from quarry.sources import datasets
    base = _tmp()
    enc = os.path.join(base, "enc.csv")
    meds = datasets.MEDICATION_COLUMNS
    with open(enc, "w") as f:
        f.write(",".join(["encounter_id", "race", *meds, "time_in_hospital", "readmitted"]) + "\n")
        f.write(",".join(["1", "?", *(["No"] * 23), "3", "NO"]) + "\n")
        f.write(",".join(["2", "X", *(["Up"] * 23), "5", ">30"]) + "\n")
    df = datasets.encounters(spark, enc).orderBy("encounter_id").collect()
    assert [r.readmitted for r in df] == [0, 1] and df[0].race is None and df[1].time_in_hospital == 5.0
    assert df[0]["glyburide-metformin"] == "No"
    rt = os.path.join(base, "ratings.csv")
    with open(rt, "w") as f:
        f.write("userId,movieId,rating,timestamp\n1,2,3.5,100\n")
    assert datasets.ratings(spark, rt).columns == ["userId", "movieId", "rating"]
    gs = os.path.join(base, "gs.csv")
    with open(gs, "w") as f:
        f.write("movieId,tagId,relevance\n1,1,0.02875\n")
    assert datasets.genome_scores(spark, gs).first().relevance == 0.02875
    gt = os.path.join(base, "gt.csv")
    with open(gt, "w") as f:
        f.write("tagId,tag\n1,007\n")
    assert datasets.genome_tags(spark, gt).first().tag == "007"
    cr = os.path.join(base, "puf.csv")
    with open(cr, "w") as f:
        f.write(",".join(["1"] * 128 + ["-1"]) + "\n")
    row = datasets.challenge_response(spark, cr).first()
    assert row["_c128"] == -1 and row["_c0"] == 1.0
    with open(cr, "w") as f:  # the width is the file's
        f.write(",".join(["1"] * 130 + ["-1"]) + "\n")
    df = datasets.challenge_response(spark, cr)
    assert split_features_label(df.columns) == ([f"_c{i}" for i in range(130)], "_c130")
    assert df.first()["_c130"] == -1
    with pytest.raises(ValueError):
        datasets.challenge_response(spark, cr, 128)


def test_log_text_is_spread_whatever_its_name(spark):
    base = _tmp()
    lines = standins.log_lines(spark, SF_SMALL)
    n, cores = lines.count(), spark.sparkContext.defaultParallelism
    for name, files in (("one", 1), ("many", 2 * cores)):
        lines.repartition(files).write.option("compression", "gzip").text(os.path.join(base, name))
    for path in ("one", "one/*.gz", "many/*.gz", "many"):
        df = read_log_text(spark, os.path.join(base, path))
        assert df.count() == n and df.rdd.getNumPartitions() >= cores


def test_embedding_width_comes_from_the_data(spark):
    emb = spark.createDataFrame([([1.0] * 128,), ([2.0] * 128,)], "embedding array<float>")
    assert standins.embedding_width(emb) == 128
    with pytest.raises(ValueError):
        standins.embedding_width(emb.union(spark.createDataFrame([([1.0],)], "embedding array<float>")))


def test_stream_restarts_from_checkpoint(spark):
    from quarry.streaming.weblog_stream import class_counts_stream, start_class_counts
    base = _tmp()
    src, out, ckpt = (os.path.join(base, p) for p in ("src", "out", "ckpt"))
    lines = standins.log_lines(spark, SF_SMALL)
    lines.repartition(2).write.text(os.path.join(src, "a"))
    start_class_counts(spark, os.path.join(src, "*"), out, ckpt).awaitTermination()
    first = {r.country_code: r["count"] for r in spark.read.parquet(out).collect()}
    lines.repartition(2).write.text(os.path.join(src, "b"))      # new files arrive
    start_class_counts(spark, os.path.join(src, "*"), out, ckpt).awaitTermination()
    second = {r.country_code: r["count"] for r in spark.read.parquet(out).collect()}
    assert second == {k: 2 * v for k, v in first.items()}        # state restored, old files not re-read
