from pyspark.sql import functions as F

from quarry.operators import splits


def _ids(spark, n=2000):
    return spark.range(n).withColumn("label", (F.col("id") % 3).cast("int"))


def test_hash_split_disjoint_complete_and_stable(spark):
    df = _ids(spark)
    tr, te = splits.hash_split(df, "id", 0.8)
    a, b = {r.id for r in tr.collect()}, {r.id for r in te.collect()}
    assert not (a & b) and len(a | b) == 2000
    assert 0.75 < len(a) / 2000 < 0.85
    tr2, _ = splits.hash_split(df.repartition(5), "id", 0.8)
    assert {r.id for r in tr2.collect()} == a


def test_nested_samples(spark):
    df = _ids(spark)
    s20 = {r.id for r in splits.hash_sample(df, "id", 0.2).collect()}
    s40 = {r.id for r in splits.hash_sample(df, "id", 0.4).collect()}
    assert s20 < s40
    sizes = {(r.fraction, r.label): r["count"] for r in
             splits.nested_sample_sizes(df, "id", [0.2, 0.4], "label").collect()}
    assert sum(v for (f, _), v in sizes.items() if f == 0.2) == len(s20)


def test_folds_cover_everything(spark):
    df = splits.with_fold(_ids(spark), "id", 4)
    counts = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and sum(counts.values()) == 2000
    tr, te = splits.fold_split(df, 2)
    assert tr.count() + te.count() == 2000


def test_subtract_deduplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "x int")
    train = df.filter("x = 3")
    assert sorted(r.x for r in df.subtract(train).collect()) == [1, 2]


def test_sample_by_fraction_roughly_kept(spark):
    df = _ids(spark, 6000)
    n = splits.sample_by(df, "label", 0.5, labels=[0, 1, 2]).count()
    assert 2600 < n < 3400


def test_sample_of_a_split_part_is_independent_of_the_split(spark):
    df = _ids(spark, 20000)
    train, _ = splits.hash_split(df, "id", 0.8)
    n_train = train.count()
    n80 = splits.hash_sample(train, "id", 0.8).count()
    assert 0.77 < n80 / n_train < 0.83          # 80 % of train, not all of it
    folds = splits.with_fold(splits.hash_sample(train, "id", 0.5), "id", 3, "f", salt=splits.FOLD_SALT)
    sizes = [r["count"] for r in folds.groupBy("f").count().collect()]
    assert len(sizes) == 3 and min(sizes) / max(sizes) > 0.9
