"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads whole driver tables (or data Spark derives from them).
Floating-point outputs that the two engines may sum in different orders are
rounded to 6 decimals on both sides (display rounding, applied last); values
computed by the same IEEE operations on both sides are left as they are, and
means over fixed-precision inputs are exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.functions import vector_to_array

from quarry import checks, oracle
from quarry.functions.hashing import unit_interval
from quarry.functions.logparse import parse_log
from quarry.functions.recode import binary_recode, sign_to_binary
from quarry.operators import aggregates, features, metrics, models, ranking, splits, tuning
from quarry.operators.grids import fold_summary as _fold_summary, metric_matrix
from quarry.plans import recommend, scaling, tabular, weblog, wide
from quarry.session import checkpoint_dir, settled
from quarry.sources import standins
from quarry.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- web logs

def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log(standins.log_lines(spark, sf_dir))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weblog.request_cube(standins.log_lines(spark, sf_dir))


def class_counts(spark, sf_dir):
    return weblog.class_counts(_cube(spark, sf_dir))


def class_counts_edu(spark, sf_dir):
    """C1 on the part of the log from one class of hosts: the others count 0."""
    lines = standins.log_lines(spark, sf_dir).where(F.col("value").rlike(r"^\S+\.edu - "))
    return weblog.class_counts(weblog.request_cube(lines))


def org_distinct(spark, sf_dir):
    return weblog.org_distinct(_cube(spark, sf_dir))


def org_topn(spark, sf_dir):
    return weblog.org_top(_cube(spark, sf_dir), 9)


def org_rank(spark, sf_dir):
    return weblog.org_rank(_cube(spark, sf_dir), "uni5")


def org_rank_uk(spark, sf_dir):
    """T4 as recorded: the rank within one class only."""
    return weblog.org_rank(_cube(spark, sf_dir), "uni9", klass="UK")


def org_share(spark, sf_dir):
    return weblog.org_share(_cube(spark, sf_dir), 9)


def hour_grid(spark, sf_dir):
    return weblog.busiest_org_grid(_cube(spark, sf_dir))


# ---------------------------------------------------------------- URLs (F1-style regex + T1)

URL_HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
TLD_PATTERN = r"\.([A-Za-z0-9-]+)$"


def url_host_topn(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("url")
    hosts = pages.select(F.regexp_extract("url", URL_HOST_PATTERN, 1).alias("host"))
    hosts = hosts.withColumn("tld", F.regexp_extract("host", TLD_PATTERN, 1))
    counts = aggregates.count_per_key(hosts, ["tld", "host"])
    return ranking.top_n_per_group(counts, "tld", "count", 5, tie_cols=["host"])


# ---------------------------------------------------------------- sort / top-k

def multi_sort(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    counts = aggregates.count_per_key(o, ["o_orderpriority", "o_orderstatus"])
    return ranking.multi_sort(counts, [("o_orderpriority", True), ("count", False)])


def topk(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.top_k(o, "o_totalprice", 3, tie_cols=["o_orderkey"])


# ---------------------------------------------------------------- splits

def strat_split(spark, sf_dir):
    lab = splits.split_label(read_table(spark, sf_dir, "labels"), "doc_id", 0.8)
    return aggregates.class_distribution(lab, "quality", part_col="split")


def split_complement(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    train, _ = splits.hash_split(lab, "doc_id", 0.8)
    return lab.subtract(train)


def class_dist(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    u = unit_interval("event_id", salt=splits.SAMPLE_SALT)
    wide = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_all"),
                                        F.sum(F.when(u < 0.1, 1).otherwise(0)).cast("bigint").alias("n_sample"))
    return wide.selectExpr("event_type", "stack(2, 'all', n_all, 'sample', n_sample) AS (part, count)")


def rating_fold_sizes(spark, sf_dir):
    """D3: ratings per fold, folds hashed on (userId, movieId) as in ``recommend.als_cv``."""
    rf = splits.with_fold(standins.ratings(spark, sf_dir), ["userId", "movieId"], 4)
    return aggregates.count_per_key(rf, "fold")


def kfold_sizes(spark, sf_dir):
    li = splits.with_fold(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 4)
    return aggregates.count_per_key(li, "fold")


def sample_sizes(spark, sf_dir):
    wb = standins.wide_binary(spark, sf_dir).select("vec_id", "label")
    return splits.nested_sample_sizes(wb, "vec_id", [0.2, 0.4, 0.6, 0.8], label_col="label")


def sample_by(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return splits.sample_by(ev, "event_type", 0.1)


def strat_sample(spark, sf_dir):
    """D1 with a fraction per class: the i-th class in order keeps i tenths of its rows."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    fractions = {label: 0.1 * (i + 1) for i, label in enumerate(splits.class_labels(ev, "event_type"))}
    sample = splits.hash_sample(ev, "event_id", fractions, label_col="event_type")
    return aggregates.count_per_key(sample, "event_type")


# ---------------------------------------------------------------- recodes

def recode_binary(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", binary_recode(F.col("o_orderstatus"), "F").alias("label"))


def recode_sign(spark, sf_dir):
    wb = standins.wide_binary(spark, sf_dir).select("vec_id", F.col("label").alias("label_pm"))
    return wb.withColumn("label", sign_to_binary(F.col("label_pm")))


# ---------------------------------------------------------------- features

def _encoded_parts(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    cats = ["p_brand", "p_type"]
    model = features.categorical_pipeline(cats, "cat_features").fit(part)
    return model.transform(part)


def string_index(spark, sf_dir):
    enc = _encoded_parts(spark, sf_dir)
    return enc.select("p_partkey", "p_brand", F.col("p_brand_index").cast("int").alias("p_brand_index"),
                      "p_type", F.col("p_type_index").cast("int").alias("p_type_index"))


def one_hot(spark, sf_dir):
    enc = _encoded_parts(spark, sf_dir)
    b, t = vector_to_array("p_brand_vec"), vector_to_array("p_type_vec")
    return enc.select("p_partkey",
                      (F.array_position(b, 1.0) - 1).cast("int").alias("brand_hot"),
                      F.size(b).alias("brand_width"),
                      (F.array_position(t, 1.0) - 1).cast("int").alias("type_hot"),
                      F.size(t).alias("type_width"),
                      F.aggregate(vector_to_array("cat_features"), F.lit(0.0), lambda a, x: a + x).alias("ones"))


def assemble(spark, sf_dir):
    enc = _encoded_parts(spark, sf_dir)
    asm = features.assembler(["p_size", "p_retailprice", "p_brand_vec"], "x").transform(enc)
    arr = vector_to_array("x")
    return asm.select("p_partkey", F.size(arr).alias("width"),
                      F.element_at(arr, 1).alias("x0"), F.element_at(arr, 2).alias("x1"),
                      (F.array_position(F.slice(arr, 3, F.size(arr) - 2), 1.0) - 1).cast("int").alias("hot_pos"))


def standardize(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice",
                                                    F.col("p_size").cast("double").alias("p_size"))
    asm = features.assembler(["p_retailprice", "p_size"], "raw").transform(part)
    scaled = features.standardizer("raw", "z").fit(asm).transform(asm)
    z = vector_to_array("z")
    return scaled.select("p_partkey", F.round(F.element_at(z, 1), 6).alias("z_price"),
                         F.round(F.element_at(z, 2), 6).alias("z_size"))


# ---------------------------------------------------------------- metrics

def _predictors():
    return [("m1", F.col("l_extendedprice") / 2000.0),
            ("m2", F.col("l_extendedprice") / 1500.0),
            ("m3", F.lit(25.5))]


def _lineitem_predictions(spark, sf_dir):
    li = splits.with_fold(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"),
                          "l_orderkey", 4)
    arms = [F.struct(F.lit(i).alias("grid_index"), F.lit(name).alias("model"), expr.alias("prediction"))
            for i, (name, expr) in enumerate(_predictors())]
    return li.select("fold", "l_quantity", F.explode(F.array(*arms)).alias("p")).select(
        "fold", "l_quantity", "p.grid_index", "p.model", "p.prediction")


def _round_cols(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rmse_mae(spark, sf_dir):
    li = splits.with_fold(read_table(spark, sf_dir, "lineitem"), "l_orderkey", 4)
    pred = li.withColumn("prediction", F.col("l_extendedprice") / 2000.0)
    return _round_cols(metrics.regression_metrics(pred, "l_quantity", "prediction", "fold"), ["rmse", "mae"])


def _embedding_scores(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    n_models = standins.embedding_width(emb)
    y = (F.col("label") >= 5).cast("int").alias("y")
    arms = [F.struct(F.lit(f"e{k}").alias("model"), F.element_at("embedding", k + 1).cast("double").alias("score"))
            for k in range(n_models)]
    return emb.select(y, F.explode(F.array(*arms)).alias("s")).select("y", "s.model", "s.score")


def accuracy(spark, sf_dir):
    sc = _embedding_scores(spark, sf_dir).withColumn("prediction", (F.col("score") > 0).cast("double"))
    return _round_cols(metrics.accuracy(sc, "y", "prediction", "model"), ["accuracy"])


def auc_exact(spark, sf_dir):
    sc = _embedding_scores(spark, sf_dir)
    return _round_cols(metrics.auc_exact(sc, "y", "score", "model"), ["auc"])


def _fold_metrics(spark, sf_dir):
    return metrics.regression_metrics(_lineitem_predictions(spark, sf_dir), "l_quantity", "prediction",
                                      ["grid_index", "model", "fold"])


def fold_summary(spark, sf_dir):
    fm = _fold_metrics(spark, sf_dir)
    out = _fold_summary(fm, ["grid_index", "model"], "fold", "rmse", [0, 1, 2, 3])
    return _round_cols(out, [c for c in out.columns if c.startswith("rmse")])


def best_param(spark, sf_dir):
    fm = _fold_metrics(spark, sf_dir)
    means = fm.groupBy("grid_index", "model").agg(F.avg("rmse").alias("rmse_mean"))
    best = aggregates.arg_best(means, "rmse_mean", "grid_index", maximize=False, payload_cols=["model"])
    return _round_cols(best, ["rmse_mean"])


# ---------------------------------------------------------------- cluster profiles

CLUSTER_K = 19
RELEVANCE_THRESHOLD = 0.05


def _profile(spark, sf_dir):
    clusters = standins.fixed_clusters(spark, sf_dir, CLUSTER_K)
    return recommend.cluster_profile(clusters, standins.relevance_scores(spark, sf_dir),
                                     standins.tag_dictionary(spark, sf_dir),
                                     n_clusters=3, n_tags=3, threshold=RELEVANCE_THRESHOLD)


def top_clusters(spark, sf_dir):
    return recommend.top_clusters(standins.fixed_clusters(spark, sf_dir, CLUSTER_K), 3)


def cluster_top_tags(spark, sf_dir):
    prof = _profile(spark, sf_dir)
    return prof.select("cluster", "tagId", "tag", F.round("avg_relevance", 6).cast("double").alias("avg_relevance"),
                       "rank")


def cluster_tag_counts(spark, sf_dir):
    return _profile(spark, sf_dir).select("cluster", "tagId", "tag", "n_items")


# ---------------------------------------------------------------- ML analyses
#
# Each analysis runs once per session and data folder, with the recorded
# grids; its registered views read the results.

WIDE_FRACTION = 0.5


class Analyses:
    """The tuned analyses of one data folder; each is computed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def glm(self) -> dict[str, DataFrame]:
        train, test = _encounter_split(self.spark, self.sf_dir)
        return tabular.tune_glms(train, test, ["l_returnflag", "p_brand", "p_type"], "l_quantity", "status_flag",
                                 parallelism=4, id_cols=["l_orderkey", "l_linenumber"])

    @cached_property
    def _wide(self) -> wide.WideTuning:
        train, test = _wide_split(self.spark, self.sf_dir)
        return wide.WideTuning(train, test, standins.wide_features(train), "label", WIDE_FRACTION, id_col="vec_id",
                               parallelism=16)

    @cached_property
    def rf(self) -> dict[str, DataFrame]:
        return self._wide.tune("rf", wide.FAMILY_GRIDS["rf"])

    @cached_property
    def gbt(self) -> dict[str, DataFrame]:
        return self._wide.tune("gbt", wide.FAMILY_GRIDS["gbt"])

    @cached_property
    def mlp(self) -> dict[str, DataFrame]:
        return self._wide.tune("mlp", wide.FAMILY_GRIDS["mlp"])

    def wide(self, view: str) -> DataFrame:
        return tuning.united([self.rf[view], self.gbt[view], self.mlp[view]])

    @cached_property
    def scaling(self) -> tuple[DataFrame, DataFrame]:
        train, test = _wide_split(self.spark, self.sf_dir)
        return scaling.scaling_study(train, test, standins.wide_features(train), "label", "vec_id")

    @cached_property
    def als(self) -> tuple[DataFrame, dict[int, DataFrame]]:
        return recommend.als_cv(standins.ratings(self.spark, self.sf_dir), k=4, keep_item_factors=0)

    @cached_property
    def clusters(self) -> DataFrame:
        return settled(recommend.fold_clusters(self.als[1], CLUSTER_K))


def analyses(spark: SparkSession, sf_dir: str) -> Analyses:
    """The session's analyses of a folder; they go with the session."""
    return vars(spark).setdefault("_quarry_analyses", {}).setdefault(sf_dir, Analyses(spark, sf_dir))


def _encounter_split(spark, sf_dir):
    enc = tabular.prepare_binary_label(standins.encounters(spark, sf_dir), "l_linestatus", "F", "status_flag")
    return tabular.split_encounters(enc, ["l_orderkey", "l_linenumber"])


def glm_split_dist(spark, sf_dir):
    return tabular.split_counts(*_encounter_split(spark, sf_dir), "status_flag")


def poisson_cv(spark, sf_dir):
    return analyses(spark, sf_dir).glm["curves"].filter(F.col("model") == "poisson")


def logit_l2_cv(spark, sf_dir):
    return analyses(spark, sf_dir).glm["curves"].filter(F.col("model") == "logistic_l2")


def logit_en_cv(spark, sf_dir):
    return analyses(spark, sf_dir).glm["curves"].filter(F.col("model") == "logistic_en")


def en_matrix(spark, sf_dir):
    return analyses(spark, sf_dir).glm["en_matrix"]


def glm_best(spark, sf_dir):
    return analyses(spark, sf_dir).glm["best"]


def glm_test_report(spark, sf_dir):
    return analyses(spark, sf_dir).glm["test_report"]


def _wide_split(spark, sf_dir):
    wb = standins.wide_binary(spark, sf_dir)
    return splits.hash_split(wb, "vec_id", 0.8)


def rf_cv(spark, sf_dir):
    return analyses(spark, sf_dir).rf["curve"]


def gbt_cv(spark, sf_dir):
    return analyses(spark, sf_dir).gbt["curve"]


def mlp_cv(spark, sf_dir):
    return analyses(spark, sf_dir).mlp["curve"]


def wide_best(spark, sf_dir):
    return analyses(spark, sf_dir).wide("best")


def wide_test_report(spark, sf_dir):
    return analyses(spark, sf_dir).wide("test_report")


def wide_class_dist(spark, sf_dir):
    train, _ = _wide_split(spark, sf_dir)
    return wide.sample_counts(train, "label", WIDE_FRACTION, "vec_id")


def wide_sample_share(spark, sf_dir):
    """F15 in C6: the measured share of the sample."""
    share = wide.sample_share(wide_class_dist(spark, sf_dir))
    return _round_cols(share, ["percent"])


def scaling_study(spark, sf_dir):
    return analyses(spark, sf_dir).scaling[0]


def scaling_sizes(spark, sf_dir):
    """C7's nested sample sizes, per model of the study."""
    train, _ = _wide_split(spark, sf_dir)
    sizes = splits.nested_sample_sizes(train, "vec_id", scaling.SAMPLE_SIZES)
    return sizes.select(F.col("fraction").alias("sample_size"), F.col("count").alias("sample_count"),
                        F.explode(F.array(*map(F.lit, scaling.FAMILIES))).alias("model"))


def scaling_report(spark, sf_dir):
    study = analyses(spark, sf_dir).scaling[1]
    return scaling.report_of(study.withColumn("sample_size_percent", F.col("sample_size") * F.lit(100.0)))


def als_cv(spark, sf_dir):
    return analyses(spark, sf_dir).als[0]


def als_fold_counts(spark, sf_dir):
    """Scored test ratings per (model, fold): cold-start rows dropped (deterministic part of C9)."""
    return analyses(spark, sf_dir).als[0].select("model", "fold", "n")


def als_summary(spark, sf_dir):
    return recommend.als_summary(analyses(spark, sf_dir).als[0], 4)


def cluster_sizes(spark, sf_dir):
    """C10 on every fold's item factors."""
    return aggregates.count_per_key(analyses(spark, sf_dir).clusters, ["fold", "cluster"])


def als_cluster_tags(spark, sf_dir):
    """C11 + C12 on every fold's clusters, in one plan."""
    return recommend.cluster_profile(analyses(spark, sf_dir).clusters, standins.relevance_scores(spark, sf_dir),
                                     standins.tag_dictionary(spark, sf_dir), 3, 3, RELEVANCE_THRESHOLD, by=["fold"])


def fold_cluster_tags(spark, sf_dir):
    """The same plan on assignments that no model makes: cluster = (size + fold) mod k."""
    part = read_table(spark, sf_dir, "part")
    fixed = part.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"),
                        F.col("p_partkey").cast("int").alias("id"), "p_size")
    fixed = fixed.select("fold", "id", ((F.col("p_size") + F.col("fold")) % CLUSTER_K).cast("int").alias("cluster"))
    prof = recommend.cluster_profile(fixed, standins.relevance_scores(spark, sf_dir),
                                     standins.tag_dictionary(spark, sf_dir), 3, 3, RELEVANCE_THRESHOLD, by=["fold"])
    return prof.withColumn("avg_relevance", F.round("avg_relevance", 6).cast("double"))


# ---------------------------------------------------------------- models with a closed form

def _by_brand(spark, sf_dir):
    """Encounters with one one-hot column, the brand, less its last level."""
    enc = tabular.prepare_binary_label(standins.encounters(spark, sf_dir), "l_linestatus", "F", "status_flag")
    return features.categorical_pipeline(["p_brand"], "features", drop_last=True).fit(enc).transform(enc)


def poisson_means(spark, sf_dir):
    """L1: with one category and no penalty the prediction is the mean of the category."""
    enc = _by_brand(spark, sf_dir)
    scored = models.poisson_glm("features", "l_quantity").fit(enc).transform(enc)
    return _round_cols(scored.groupBy("p_brand").agg(F.avg("prediction").alias("prediction")), ["prediction"], 4)


def logistic_shares(spark, sf_dir):
    """L2 / L3: with one category and no penalty the probability is the share of the category."""
    enc = _by_brand(spark, sf_dir)
    scored = models.logistic("features", "status_flag").fit(enc).transform(enc)
    p = vector_to_array("probability").getItem(1)
    return _round_cols(scored.groupBy("p_brand").agg(F.avg(p).alias("probability")), ["probability"], 4)


def poisson_fold_metrics(spark, sf_dir):
    """Cross-validated RMSE of the category means on hash folds, mean and population std."""
    enc = splits.with_fold(standins.encounters(spark, sf_dir), ["l_orderkey", "l_linenumber"], 3, "cv_fold", salt=splits.FOLD_SALT)
    groups = settled(tabular.grouped_rows(enc, ["p_brand", "cv_fold"], "l_quantity"))
    coded = features.categorical_pipeline(["p_brand"], "features", drop_last=True).fit(enc).transform(groups)
    est = models.poisson_glm("features", "l_quantity", weight_col=tabular.N_ROWS)
    grid = tuning.param_grid(est, {"regParam": [0.0]})
    error = metrics.GroupedRmse("l_quantity", tabular.N_ROWS, tabular.SQUARES)
    fitted = tuning.cross_validate(est, grid, error, coded, 3, fold_col="cv_fold")
    curve = tuning.validation_curve(spark, fitted, grid)
    return _round_cols(curve, ["mean_metric", "std_metric"], 4)


def _flagged(spark, sf_dir):
    """A 0/1 column whose two sides differ in the majority of the label (a tree joins sibling leaves of one class)."""
    flag = (F.col("l_linestatus") != "F").cast("double")
    li = read_table(spark, sf_dir, "lineitem").select(
        flag.alias("flag"), (F.col("l_quantity") + 20 * flag > 30).cast("int").alias("y"))
    return features.assembler(["flag"], "features").transform(li)


def tree_shares(spark, sf_dir):
    """L4: one tree with one split on a 0/1 column, no bootstrap: the shares of its leaves."""
    li = _flagged(spark, sf_dir)
    est = models.random_forest("features", "y", numTrees=1, maxDepth=1, bootstrap=False, subsamplingRate=1.0,
                               featureSubsetStrategy="all")
    scored = est.fit(li).transform(li)
    p = vector_to_array("probability").getItem(1)
    return _round_cols(scored.groupBy("flag").agg(F.avg(p).alias("probability")), ["probability"], 5)


def boosted_signs(spark, sf_dir):
    """One boosting step with one split predicts the majority of each leaf."""
    li = _flagged(spark, sf_dir)
    scored = models.gbt("features", "y", maxIter=1, maxDepth=1).fit(li).transform(li)
    return scored.groupBy("flag").agg(F.max("prediction").alias("prediction"))


def cluster_planted(spark, sf_dir):
    """K-means finds two groups that lie far apart."""
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 2).cast("int").alias("planted"),
        (F.col("p_size") % 2 * 1e6 + F.col("p_size")).cast("double").alias("x"))
    found = models.cluster(features.assembler(["x"], "features").transform(part), k=2)
    return (part.select("id", "planted").join(found, "id").groupBy("planted")
            .agg(F.count(F.lit(1)).alias("count"), F.count_distinct("cluster").alias("n_clusters")))


def als_dot_products(spark, sf_dir):
    """A prediction is the dot product of the factors of its user and item."""
    ratings = settled(standins.ratings(spark, sf_dir))  # read by the fit and by the scoring
    model = models.als(rank=4, maxIter=2).fit(ratings)
    users = model.userFactors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    items = model.itemFactors.select(F.col("id").alias("movieId"), F.col("features").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    both = model.transform(ratings).join(items, "movieId").join(users, "userId")  # the scored rows lie by item
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.abs(dot - F.col("prediction")) > 1e-3 * (1 + F.abs(dot))).alias("mismatches"))


def fold_matrix(spark, sf_dir):
    """Model x fold matrix of the RMSE."""
    out = metric_matrix(_fold_metrics(spark, sf_dir), "model", "fold", "rmse", [0, 1, 2, 3])
    return _round_cols(out, [c for c in out.columns if c != "model"])


def evaluator_table(spark, sf_dir):
    """M5: MLlib's evaluators on the arithmetic predictors."""
    scored = _lineitem_predictions(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity").cast("double"))
    by_model = {name: scored.where(F.col("model") == name).withColumn("prediction", F.col("prediction").cast("double"))
                for name, _ in _predictors()}
    out = metrics.evaluation_table(spark, by_model, {"rmse": metrics.rmse_evaluator("l_quantity"),
                                                     "mae": metrics.mae_evaluator("l_quantity")})
    return _round_cols(out, ["value"])


def scaling_report_counts(spark, sf_dir):
    """C8 / S6 on results made of counts: accuracy, auc and seconds are multiples of the sample size."""
    train, _ = _wide_split(spark, sf_dir)
    sizes = splits.nested_sample_sizes(train, "vec_id", scaling.SAMPLE_SIZES)
    n = F.col("count").cast("double")
    wide_rows = sizes.select((F.col("fraction") * F.lit(100.0)).alias("sample_size_percent"),
                             F.col("count").alias("sample_count"),
                             *[(n * (3 * i + j + 1)).alias(f"{m}_{c}") for i, m in enumerate(scaling.FAMILIES)
                               for j, c in enumerate(("accuracy", "auc", "time"))])
    return _round_cols(scaling.report_of(wide_rows), ["rows_per_second"])


# ---------------------------------------------------------------- streaming (C1 on a file stream)

def stream_class_counts(spark, sf_dir):
    """C1 computed by a Structured Streaming query over log files that Spark
    writes from ``events`` into the shared checkpoint folder, or the warehouse."""
    import uuid

    from quarry.streaming.weblog_stream import start_class_counts

    base = f"{checkpoint_dir(spark) or spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid.uuid4().hex}"
    src, out, ckpt = (f"{base}/{p}" for p in ("src", "out", "ckpt"))
    standins.log_lines(spark, sf_dir).repartition(4).write.text(src)
    query = start_class_counts(spark, src, out, ckpt, max_files_per_trigger=2)
    query.awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- read-out of the tuned analyses

def _readout(curves: DataFrame, best: DataFrame, smaller: list[str]) -> DataFrame:
    """(model, n_points, best_first): grid points of each curve, and whether the reported best point is the
    first with the best mean over all of them."""
    sign = F.when(F.col("model").isin(smaller), -1.0).otherwise(1.0)
    top = curves.groupBy("model").agg(F.count(F.lit(1)).alias("n_points"),
                                      F.max(F.struct((sign * F.col("mean_metric")).alias("m"), (-F.col("grid_index")).alias("i"))).alias("top"))
    told = best.select("model", F.col("grid_index").alias("told"), F.col("mean_metric").alias("mean"))
    same = (F.col("told") == -F.col("top.i")) & (F.abs(F.col("mean")) == F.abs(F.col("top.m")))
    return top.join(told, "model").select("model", "n_points", same.alias("best_first"))


def glm_readout(spark, sf_dir):
    found = analyses(spark, sf_dir).glm
    return _readout(found["curves"], found["best"], ["poisson"])


def wide_readout(spark, sf_dir):
    found = analyses(spark, sf_dir)
    return _readout(found.wide("curve"), found.wide("best"), [])


def als_readout(spark, sf_dir):
    """Folds and scored ratings of each configuration, and whether its summary has the means of its folds."""
    metrics_ = analyses(spark, sf_dir).als[0]
    per_model = metrics_.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n_scored"),
                                              F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    both = per_model.join(recommend.als_summary(metrics_, 4), "model")
    near = [F.abs(F.col(c) - F.col(f"{c}_mean")) < 1e-9 for c in ("rmse", "mae")]
    return both.select("model", "n_folds", "n_scored", (near[0] & near[1] & (F.col("rmse") >= F.col("mae"))).alias("same"))


def queries() -> dict[str, Query]:
    return {
        "log_parse": log_parse,
        "class_counts": class_counts,
        "org_distinct": org_distinct,
        "org_topn": org_topn,
        "org_rank": org_rank,
        "org_rank_uk": org_rank_uk,
        "org_share": org_share,
        "hour_grid": hour_grid,
        "url_host_topn": url_host_topn,
        "multi_sort": multi_sort,
        "topk": topk,
        "strat_split": strat_split,
        "split_complement": split_complement,
        "class_dist": class_dist,
        "kfold_sizes": kfold_sizes,
        "rating_fold_sizes": rating_fold_sizes,
        "sample_sizes": sample_sizes,
        "sample_by": sample_by,
        "recode_binary": recode_binary,
        "recode_sign": recode_sign,
        "string_index": string_index,
        "one_hot": one_hot,
        "assemble": assemble,
        "standardize": standardize,
        "rmse_mae": rmse_mae,
        "accuracy": accuracy,
        "auc_exact": auc_exact,
        "fold_summary": fold_summary,
        "best_param": best_param,
        "top_clusters": top_clusters,
        "cluster_top_tags": cluster_top_tags,
        "cluster_tag_counts": cluster_tag_counts,
        "glm_split_dist": glm_split_dist,
        "poisson_cv": poisson_cv,
        "logit_l2_cv": logit_l2_cv,
        "logit_en_cv": logit_en_cv,
        "en_matrix": en_matrix,
        "glm_best": glm_best,
        "glm_test_report": glm_test_report,
        "rf_cv": rf_cv,
        "gbt_cv": gbt_cv,
        "mlp_cv": mlp_cv,
        "wide_best": wide_best,
        "wide_test_report": wide_test_report,
        "wide_class_dist": wide_class_dist,
        "scaling_study": scaling_study,
        "scaling_sizes": scaling_sizes,
        "scaling_report": scaling_report,
        "als_cv": als_cv,
        "als_fold_counts": als_fold_counts,
        "als_summary": als_summary,
        "cluster_sizes": cluster_sizes,
        "als_cluster_tags": als_cluster_tags,
        "strat_sample": strat_sample,
        "class_counts_edu": class_counts_edu,
        "wide_sample_share": wide_sample_share,
        "fold_cluster_tags": fold_cluster_tags,
        "poisson_means": poisson_means,
        "logistic_shares": logistic_shares,
        "poisson_fold_metrics": poisson_fold_metrics,
        "tree_shares": tree_shares,
        "boosted_signs": boosted_signs,
        "cluster_planted": cluster_planted,
        "als_dot_products": als_dot_products,
        "fold_matrix": fold_matrix,
        "evaluator_table": evaluator_table,
        "scaling_report_counts": scaling_report_counts,
        "stream_class_counts": stream_class_counts,
        "glm_readout": glm_readout,
        "wide_readout": wide_readout,
        "als_readout": als_readout,
    } | checks.queries()


def oracle_sql() -> dict[str, str]:
    sql = oracle.all_sql() | checks.all_sql()
    return {k: v for k, v in sql.items() if k in queries()}
