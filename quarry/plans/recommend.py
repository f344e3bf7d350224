"""Recommender cross-validation and cluster profiles.

* ``als_cv`` — ALS configurations x k deterministic folds; each model is
  scored as it is fitted and let go.
* ``top_clusters`` / ``cluster_profile`` — the largest clusters and, for each,
  the top tags by mean relevance with the number of items above a relevance
  threshold. One join of cluster members to relevance scores serves both
  answers (the reference ran one join per cluster and one per tag).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators.joins import join_bounded
from quarry.operators.metrics import regression_metrics, valid_predictions
from quarry.operators.ranking import top_n_per_group
from quarry.operators.splits import fold_split, with_fold
from quarry.operators.tuning import run_concurrently
from quarry.session import let_go, saved_model, settled, with_checkpoints


def cluster_sizes(clustered: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Items per cluster."""
    return clustered.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("count"))


def top_clusters(clustered: DataFrame, n: int = 3, cluster_col: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest clusters (ties by cluster id), per value of the columns ``by``."""
    if not by:
        sizes = cluster_sizes(clustered, cluster_col)
        return sizes.orderBy(F.col("count").desc(), F.col(cluster_col).asc()).limit(n)
    sizes = clustered.groupBy(*by, cluster_col).agg(F.count(F.lit(1)).alias("count"))
    return top_n_per_group(sizes, list(by), "count", n, tie_cols=[cluster_col]).drop("rank")


def cluster_profile(clustered: DataFrame, relevance: DataFrame, tags: DataFrame, n_clusters: int = 3,
                    n_tags: int = 3, threshold: float = 0.5, id_col: str = "id",
                    item_col: str = "movieId", by: Sequence[str] = ()) -> DataFrame:
    """C11 + C12: for each of the ``n_clusters`` largest clusters, its ``n_tags`` tags by mean
    relevance (J1, A6, T1, J2) and how many of its items have relevance above
    ``threshold`` for that tag (P11, J3).

    With ``by`` (a fold column) every assignment of a union is profiled in the
    same plan, with one read of ``relevance``. Output ``(*by, cluster, rank,
    tagId, tag, avg_relevance, n_items)``, sorted last.
    """
    keys = [*by, "cluster"]
    top = top_clusters(clustered, n_clusters, by=by).select(*keys)
    members = join_bounded(clustered.select(*by, F.col(id_col).alias(item_col), "cluster"), top, on=keys,
                           how="left_semi")
    scored = members.join(relevance, item_col, "inner")
    per_tag = scored.groupBy(*keys, "tagId").agg(
        F.avg("relevance").alias("avg_relevance"),
        F.count_if(F.col("relevance") > F.lit(threshold)).alias("n_items"))
    ranked = top_n_per_group(per_tag, keys, "avg_relevance", n_tags, tie_cols=["tagId"])
    named = join_bounded(tags, ranked, on="tagId")  # a few rows per cluster, whatever the tags
    return named.select(*keys, "rank", "tagId", "tag", "avg_relevance", "n_items").orderBy(*keys, "rank")


def fit_lanes(configs: Sequence[dict], k: int, lanes: int) -> list[list[tuple[int, int]]]:
    """The fits (fold, configuration) in lanes of one fit after the other.

    A configuration stays in one lane, the next costliest in the lane with the
    least work: a fit of ten tasks or more leaves cores idle that another can
    use, but two fits of the costliest configuration at once would hold its
    shuffle files, many times the ratings, twice.
    """
    rank, steps = (lambda cfg, p=p: cfg.get(p, M.als().getOrDefault(p)) for p in ("rank", "maxIter"))
    work: list[tuple[int, list[int]]] = [(0, []) for _ in range(max(1, min(lanes, len(configs))))]
    for i in sorted(range(len(configs)), key=lambda i: -steps(configs[i]) * rank(configs[i]) ** 2):
        least = min(range(len(work)), key=lambda n: work[n][0])
        work[least] = (work[least][0] + steps(configs[i]) * rank(configs[i]) ** 2, [*work[least][1], i])
    return [[(fold, i) for fold in range(k) for i in lane] for _, lane in work]


def als_cv(ratings: DataFrame, configs: Sequence[dict] = M.ALS_CONFIGS, k: int = 4,
           id_cols: Sequence[str] = ("userId", "movieId"), rating_col: str = "rating",
           keep_item_factors: int | None = None, parallelism: int = 2):
    """RMSE and MAE of each ALS configuration on each of ``k`` folds.

    Returns ``(metrics, item_factors)``: ``metrics`` is the long table
    ``(model, fold, n, rmse, mae)``; ``item_factors`` maps fold -> item
    factors of configuration ``keep_item_factors`` (for clustering, so the
    same model is not fitted twice). The configs x folds fits are independent
    and run in ``fit_lanes``, ``parallelism`` of them. A fit's files go before its
    model, saved, is scored, and the model and the files of its scores after that.
    """
    spark = with_checkpoints(ratings.sparkSession)  # without, ALS keeps the files of all iterations
    folded = settled(with_fold(ratings, list(id_cols), k))  # read by every fit
    let_go(spark)

    def fit_and_score(fold, i, cfg):
        train, test = fold_split(folded, fold)
        fitted = M.als(rating_col=rating_col, **cfg).fit(train)
        kept = settled(M.item_factors(fitted)) if i == keep_item_factors else None
        with saved_model(spark, fitted) as model:
            del fitted
            let_go(spark)
            pred = valid_predictions(model.transform(test))
            row = regression_metrics(pred, rating_col, "prediction").first()
            del model, pred
        let_go(spark)
        return (i + 1, fold, row["n"], row["rmse"], row["mae"]), kept

    lanes = fit_lanes(configs, k, parallelism)
    runs = run_concurrently([lambda jobs=jobs: [fit_and_score(fold, i, configs[i]) for fold, i in jobs] for jobs in lanes], len(lanes))
    done = sorted((found for lane in runs for found in lane), key=lambda found: (found[0][1], found[0][0]))
    metrics = spark.createDataFrame([row for row, _ in done], "model int, fold int, n bigint, rmse double, mae double")
    folded.unpersist()
    return metrics, {row[1]: kept for row, kept in done if kept is not None}


def als_summary(metrics: DataFrame, k: int = 4) -> DataFrame:
    """Per model, the per-fold RMSE / MAE, their means and population stds, in one aggregate."""
    return metrics.groupBy("model").agg(*[x for c in ("rmse", "mae") for x in (
        *[F.max(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}_fold{f}") for f in range(k)],
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def factor_clusters(item_factors: DataFrame, k: int = M.KMEANS_K, seed: int = M.SEED) -> DataFrame:
    """L8 + L9: k-means over ALS item factors -> ``(id, cluster)``."""
    return M.cluster(item_factors, k, seed, features_col="features", id_col="id")


def fold_clusters(item_factors: dict[int, DataFrame], k: int = M.KMEANS_K, seed: int = M.SEED) -> DataFrame:
    """L8 + L9 on every fold's factors: ``(fold, id, cluster)``."""
    parts = [factor_clusters(f, k, seed).select(F.lit(fold).alias("fold"), "id", "cluster")
             for fold, f in sorted(item_factors.items())]
    return reduce(DataFrame.unionByName, parts)
