"""The four recorded analyses end to end, from the original input files.

Each function returns DataFrames (nothing is printed or plotted); callers
decide what to show, write or collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tuning as G
from quarry.operators.splits import hash_split
from quarry.plans import recommend, scaling, tabular, weblog, wide
from quarry.session import settled
from quarry.sources import datasets
from quarry.sources.tables import split_features_label

ROW_KEY = "_row_key"


def content_key(df: DataFrame) -> Column:
    """A row key for tables without an id: a 64-bit hash of every column.
    Equal rows share a key (and so land in the same part), on any partitioning."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def web_logs(spark: SparkSession, log_path: str, rank_name: str | None = None, rank_class: str | None = None,
             top_n: int = 9) -> dict[str, DataFrame]:
    """Q1: requests per class, organisations, top-N, shares, busiest grids, and the
    rank of ``rank_name`` (within ``rank_class``, or every class) when given.
    ``result["cube"]`` is the checkpointed cube every answer reads."""
    wa = weblog.WeblogAnalysis(datasets.access_log(spark, log_path), top_n=top_n)
    out = wa.results(rank_name, rank_class)
    out["cube"] = wa.cube
    return out


def encounter_glms(spark: SparkSession, csv_path: str, reg_params: Sequence[float] = G.REG_PARAMS,
                   en_params: Sequence[float] = G.ELASTIC_NET_PARAMS, parallelism: int = 4) -> dict[str, DataFrame]:
    """Q2: 80/20 split, medication one-hot features, tuned Poisson / L2 / EN GLMs."""
    df = datasets.encounters(spark, csv_path)
    keep = [*datasets.MEDICATION_COLUMNS, "time_in_hospital", "readmitted"]
    id_cols = [datasets.ENCOUNTER_ID] if datasets.ENCOUNTER_ID in df.columns else [ROW_KEY]
    if id_cols == [ROW_KEY]:
        df = df.withColumn(ROW_KEY, content_key(df))
    train, test = hash_split(df.select(*id_cols, *keep), id_cols, 0.8)
    return tabular.tune_glms(train, test, datasets.MEDICATION_COLUMNS, "time_in_hospital", "readmitted",
                             reg_params, en_params, parallelism=parallelism, id_cols=id_cols)


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW_KEY, content_key(df))


def wide_tuning(spark: SparkSession, train_path: str, test_path: str, fraction: float = 0.01,
                grids: dict | None = None, n_features: int | None = None, parallelism: int = 4) -> dict[str, DataFrame]:
    """Q3A: 1 % sample of the training file, RF / GBT / MLP grid search, test report.

    The width comes from the files (a given ``n_features`` must agree)."""
    train, test, feats, label = _challenge(spark, train_path, test_path, n_features)
    return wide.tune_wide(train, test, feats, label, fraction, id_col=ROW_KEY, grids=grids, parallelism=parallelism)


def _challenge(spark: SparkSession, train_path: str, test_path: str, n_features: int | None):
    """Training (with a row key) and test rows, the feature columns and the label column."""
    train = datasets.challenge_response(spark, train_path, n_features)
    feats, label = split_features_label(train.columns)
    return _with_key(train), datasets.challenge_response(spark, test_path, len(feats)), feats, label


def sample_size_scaling(spark: SparkSession, train_path: str, test_path: str,
                        fractions: Sequence[float] = scaling.SAMPLE_SIZES, results_path: str | None = None,
                        n_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Q3B: fixed-parameter RF / GBT / MLP at several nested sample sizes."""
    train, test, feats, label = _challenge(spark, train_path, test_path, n_features)
    return scaling.scaling_study(train, test, feats, label, ROW_KEY, fractions, results_path=results_path)


def recommender(spark: SparkSession, ratings_path: str, scores_path: str, tags_path: str, k: int = 4,
                n_clusters_k: int = 19, top_clusters: int = 3, top_tags: int = 3,
                threshold: float = 0.5) -> dict:
    """Q4: ALS 3 configs x k folds (RMSE / MAE table), then per fold k-means on
    the default model's item factors and the tag profile of the largest clusters
    (``top_clusters`` and ``profile`` have a fold column)."""
    ratings = datasets.ratings(spark, ratings_path)
    metrics, factors = recommend.als_cv(ratings, k=k, keep_item_factors=0)
    scores = datasets.genome_scores(spark, scores_path)
    tags = datasets.genome_tags(spark, tags_path)
    clustered = settled(recommend.fold_clusters(factors, n_clusters_k))
    return {"metrics": metrics, "summary": recommend.als_summary(metrics, k),
            "top_clusters": recommend.top_clusters(clustered, top_clusters, by=["fold"]),
            "profile": recommend.cluster_profile(clustered, scores, tags, top_clusters, top_tags, threshold,
                                                 by=["fold"])}
