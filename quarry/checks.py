"""Registered queries that hold fitted models and file round trips against what they must satisfy.

Each has a twin in SQL: counts come from the tables on both sides, and the
number of violated conditions is zero there.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import oracle
from quarry.functions.recode import sign_to_binary
from quarry.operators import compiled, conditions, features, metrics, models, splits, tuning
from quarry.plans import tabular, weblog
from quarry.session import settled, work_folder
from quarry.sources import standins
from quarry.sources.tables import (
    append_results, positional_schema, read_log_text, read_results, read_table, scan_csv, split_features_label,
)


def _mismatches(expected, got, bound: float = 1e-6):
    return F.count_if((F.abs(expected - got) > F.lit(bound) * (1 + F.abs(expected))) | got.isNull())


# ---------------------------------------------------------------- L1-L6 as expressions
def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = standins.wide_binary(spark, sf_dir)
    y = sign_to_binary(F.col("label")).alias("label")
    rows = features.assembler(standins.wide_features(wide), "features").transform(wide)
    return rows.select("vec_id", "features", y, (F.col("vec_id") % 7).cast("double").alias("visits"))


def compiled_scores(spark, sf_dir):
    """What each fitted model says of every row, by ``transform`` and by its expression."""
    rows = settled(_wide(spark, sf_dir))
    width = len(rows.first()["features"])
    fitted = {
        "poisson": models.poisson_glm("features", "visits", max_iter=10),
        "logistic": models.logistic("features", "label", 0.01, 0.5),
        "rf": models.random_forest("features", "label", numTrees=5, maxDepth=5),
        "gbt": models.gbt("features", "label", maxIter=5, maxDepth=3, stepSize=0.2),
        "mlp": models.mlp("features", "label", models.mlp_layers(width, 8), maxIter=15, blockSize=64),
    }

    def compare(name: str, est) -> DataFrame:
        model = est.fit(rows)
        said = F.col("prediction") if name == "poisson" else vector_to_array("probability").getItem(1)
        return model.transform(rows).agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
                                         _mismatches(said, compiled.compile_model(spark, model)).alias("mismatches"))

    parts = tuning.run_concurrently([lambda n=n, e=e: compare(n, e) for n, e in fitted.items()], 5)
    return reduce(DataFrame.unionByName, parts)


def mlp_layers(spark, sf_dir):
    """The exported weights as a table, scored by joins and sums, against ``transform``."""
    rows = settled(_wide(spark, sf_dir))
    width = len(rows.first()["features"])
    model = models.mlp("features", "label", models.mlp_layers(width, 8), maxIter=15, blockSize=64).fit(rows)
    exported = compiled.perceptron_layers(model.getLayers(), model.weights.toArray().tolist())
    weights = spark.createDataFrame([(k, o, i, w) for k, (matrix, _) in enumerate(exported)
                                     for o, row in enumerate(matrix) for i, w in enumerate(row)],
                                    "layer int, unit int, input int, w double")
    biases = spark.createDataFrame([(k, o, b) for k, (_, bias) in enumerate(exported) for o, b in enumerate(bias)],
                                   "layer int, unit int, b double")

    def affine(values: DataFrame, layer: int) -> DataFrame:
        w = F.broadcast(weights.where(F.col("layer") == layer).drop("layer"))  # as many rows as the network has weights
        b = F.broadcast(biases.where(F.col("layer") == layer).drop("layer"))
        sums = values.join(w, "input").groupBy("vec_id", "unit").agg(F.sum(F.col("x") * F.col("w")).alias("z"))
        return sums.join(b, "unit").select("vec_id", "unit", (F.col("z") + F.col("b")).alias("z"))

    inputs = rows.select("vec_id", F.posexplode(vector_to_array("features")).alias("input", "x"))
    hidden = affine(inputs, 0).select("vec_id", F.col("unit").alias("input"), compiled.sigmoid(F.col("z")).alias("x"))
    out = affine(hidden, 1).groupBy("vec_id").agg(F.max(F.when(F.col("unit") == 0, F.col("z"))).alias("z0"),
                                                  F.max(F.when(F.col("unit") == 1, F.col("z"))).alias("z1"))
    said = model.transform(rows).select("vec_id", vector_to_array("probability").getItem(1).alias("p"))
    return said.join(out, "vec_id").agg(F.count(F.lit(1)).alias("n"),
                                        _mismatches(F.col("p"), compiled.sigmoid(F.col("z1") - F.col("z0"))).alias("mismatches"))


def boosting_prefixes(spark, sf_dir):
    """A grid over steps and depth from few fits, against one fit for each point."""
    rows = settled(_wide(spark, sf_dir))
    train, valid = splits.hash_split(rows, "vec_id", 0.5)
    est = models.gbt("features", "label", stepSize=0.3)
    grid = tuning.param_grid(est, {"maxDepth": [2, 4], "maxIter": [2, 6]})
    shared = tuning.search_folds(est, grid, [(train.drop("visits"), valid.drop("visits"))])
    aucs = metrics.auc_exact(shared, "label", "score", "grid_index")
    single = tuning.run_concurrently([lambda p=p: metrics.ExactAuc("label").evaluate(est.fit(train, p).transform(valid)) for p in grid], 4)
    alone = spark.createDataFrame(list(enumerate(single)), "grid_index int, alone double")
    return aucs.join(alone, "grid_index").select(
        "grid_index", F.col("n_pos"), F.col("n_neg"), (F.abs(F.col("auc") - F.col("alone")) < 1e-12).alias("same"))


# ---------------------------------------------------------------- L1-L3, L7, L9: conditions of the optimum
REG = 0.01


def score_equations(spark, sf_dir):
    """L1-L3: logistic regression with every mixing and Poisson regression on three one-hot columns."""
    enc = tabular.prepare_binary_label(standins.encounters(spark, sf_dir), "l_linestatus", "F", "status_flag")
    cols = ["l_returnflag", "p_brand", "p_type"]
    groups = tabular.grouped_rows(enc, [*cols, "status_flag"], "l_quantity")  # all that the fits and their equations need of the rows
    rows = settled(features.categorical_pipeline(cols, "features", drop_last=True).fit(enc).transform(groups)
                   .select("features", "status_flag", "l_quantity", tabular.N_ROWS))

    def logistic(mixing: float) -> DataFrame:
        est = models.grouped_logistic("features", "status_flag", tabular.N_ROWS, REG, mixing).setTol(1e-9)
        model = est.fit(rows)
        residual = compiled.compile_model(spark, model) - F.col("status_flag")
        return conditions.elastic_net_violations(rows, model, residual, REG, mixing, n_col=tabular.N_ROWS).select(
            F.lit(f"logistic_{mixing}").alias("model"), "n_coefficients", "violations")

    def poisson() -> DataFrame:
        model = models.poisson_glm("features", "l_quantity", weight_col=tabular.N_ROWS).fit(rows)
        residual = compiled.compile_model(spark, model) - F.col("l_quantity")
        return conditions.elastic_net_violations(rows, model, residual, 0.0, 0.0, n_col=tabular.N_ROWS).select(
            F.lit("poisson").alias("model"), "n_coefficients", "violations")

    jobs = [lambda m=m: logistic(m) for m in (0.0, 0.2, 0.5, 0.8, 1.0)] + [poisson]
    return reduce(DataFrame.unionByName, tuning.run_concurrently(jobs, 3))


ALS_CHECK = {"rank": 4, "maxIter": 3, "regParam": 0.1}


def _factors(spark, sf_dir):
    ratings = settled(standins.ratings(spark, sf_dir))
    return ratings, models.als(**ALS_CHECK, blocks=models.als_blocks(ratings)).fit(ratings)


def als_normal_equations(spark, sf_dir):
    """Every user's factors solve the regularised least squares over the user's ratings."""
    ratings, model = _factors(spark, sf_dir)
    residuals = conditions.als_residuals(ratings, model.userFactors, model.itemFactors, ALS_CHECK["rank"], ALS_CHECK["regParam"])
    return residuals.agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("residual") > 1e-3).alias("mismatches"))


#: A guard only: Lloyd's steps end where no centre moves, and the conditions hold there alone.
LLOYD_STEPS = 3000


def kmeans_conditions(spark, sf_dir):
    """On item factors every row is at its nearest centre and every centre is the mean of its rows."""
    _, model = _factors(spark, sf_dir)
    items = settled(model.itemFactors)
    found = models.kmeans().setMaxIter(LLOYD_STEPS).setTol(1e-9).fit(items)
    centres = [c.tolist() for c in found.clusterCenters()]
    return conditions.centre_mismatches(found.transform(items), centres, "features", "cluster")


# ---------------------------------------------------------------- G1-G4 by exact AUC
def auc_grid(spark, sf_dir):
    """A cross-validated grid of arithmetic scores, by exact AUC."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("double").alias("label"))
    rows = settled(splits.with_fold(emb, "vec_id", 3, "cv_fold", salt=splits.FOLD_SALT))
    est = models.SqlScore("element_at(embedding, {k})")
    grid = tuning.param_grid(est, {"k": [1, 2, 3, 4, 5]})
    fitted = tuning.cross_validate(est, grid, metrics.ExactAuc("label"), rows, 3, parallelism=4, fold_col="cv_fold")
    curve = tuning.validation_curve(spark, fitted, grid)
    return curve.withColumns({c: F.round(c, 6) for c in ("mean_metric", "std_metric")})


def auc_best(spark, sf_dir):
    """The selected point of the same grid, on all digits."""
    curve = auc_grid(spark, sf_dir)
    return tuning.best_point(curve, True).select("grid_index", "k", "mean_metric")


# ---------------------------------------------------------------- E1 without labels on the driver
def string_index_wide(spark, sf_dir):
    """E1 on a column with as many values as there are customers with orders."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    index = features.DistributedIndex.fit(orders, "customer")
    return index.transform(orders)


# ---------------------------------------------------------------- S1-S6: round trips through files
def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scan_log_text(spark, sf_dir):
    """The log as compressed text files, scanned and counted."""
    path = _folder(spark, "log")
    standins.log_lines(spark, sf_dir).write.option("compression", "gzip").text(path)
    return weblog.class_counts(weblog.request_cube(read_log_text(spark, path)))


ORDER_FIELDS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                             T.StructField("o_orderstatus", T.StringType()), T.StructField("o_shippriority", T.IntegerType())])


def _order_scan(spark, sf_dir):
    """Orders as CSV with a header; every 11th lacks its last field, every 13th has one more, every 17th a word for a number."""
    key = F.col("o_orderkey")
    fields = [key.cast("string"), F.when(key % 17 == 0, F.lit("many")).otherwise(F.col("o_custkey").cast("string")),
              F.col("o_orderstatus"), (key % 5).cast("string")]
    line = F.when(key % 11 == 0, F.concat_ws(",", *fields[:3])).when(key % 13 == 0, F.concat_ws(",", *fields, F.lit("more"))) \
            .otherwise(F.concat_ws(",", *fields))
    path = _folder(spark, "orders")
    lines = read_table(spark, sf_dir, "orders").select(line.alias("value"))
    lines.write.text(path)
    return scan_csv(spark, path, ORDER_FIELDS)


def scan_orders(spark, sf_dir):
    """S3: the records that fit the declared columns."""
    return _order_scan(spark, sf_dir).parsed


def scan_quarantine(spark, sf_dir):
    """S3: the records that don't, whole, with the reason."""
    return _order_scan(spark, sf_dir).quarantined


def scan_headerless(spark, sf_dir):
    """A headerless file of features and a label, some records cut short."""
    wide = standins.wide_binary(spark, sf_dir)
    names = standins.wide_features(wide)
    fields = [F.col(c).cast("string") for c in names]
    line = F.when(F.col("vec_id") % 9 == 0, F.concat_ws(",", *fields)).otherwise(F.concat_ws(",", *fields, F.col("label").cast("string")))
    path = _folder(spark, "wide")
    wide.select(line.alias("value")).write.text(path)
    scan = scan_csv(spark, path, positional_schema(len(names)))
    cols, label = split_features_label(scan.parsed.columns)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    both = (scan.parsed.select(F.lit(0).alias("bad"), F.col(label).alias("label"), total.alias("total"))
            .unionByName(scan.quarantined.select(F.lit(1).alias("bad")), allowMissingColumns=True))
    return both.agg(F.count_if(F.col("bad") == 0).alias("n"), F.sum("label").alias("labels"), F.round(F.sum("total"), 6).alias("total"),
                    F.lit(len(cols)).alias("n_features"), F.count_if(F.col("bad") == 1).alias("n_bad"))


def appended_runs(spark, sf_dir):
    """Two runs, the first of them repeated, read back as results."""
    path = _folder(spark, "results")
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id")
    for run, sizes in (("a", [0.2, 0.4]), ("b", [0.6, 0.8]), ("a", [0.2, 0.4])):
        found = splits.nested_sample_sizes(rows, "vec_id", sizes)
        append_results(found.select(F.col("fraction").alias("sample_size"), F.col("count").alias("sample_count")), path, run_id=run)
    return read_results(spark, path).select("run_id", "sample_size", "sample_count", "sample_size_percent")


def queries():
    return {f.__name__: f for f in (compiled_scores, mlp_layers, boosting_prefixes, score_equations, als_normal_equations,
                                    kmeans_conditions, auc_grid, auc_best, string_index_wide, scan_log_text, scan_orders,
                                    scan_quarantine, scan_headerless, appended_runs)}


# ---------------------------------------------------------------- the same in SQL
_AUC = f"""
e AS (SELECT vec_id, (label >= 5)::INTEGER AS y, embedding, (('0x' || substr(md5(vec_id::VARCHAR || '#31891-cv'), 1, 7))::BIGINT % 3) AS fold
      FROM embeddings),
s AS (SELECT fold, y, k, embedding[k]::DOUBLE AS score FROM e, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS k)),
r AS (SELECT k, fold, y, (rank() OVER (PARTITION BY k, fold ORDER BY score) + (count(*) OVER (PARTITION BY k, fold, score) - 1) / 2.0) AS r FROM s),
a AS (SELECT k, fold, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY ALL),
g AS (SELECT (k - 1)::INTEGER AS grid_index, k, round(avg(auc), 6)::DOUBLE AS mean_metric, round(stddev_pop(auc), 6)::DOUBLE AS std_metric FROM a GROUP BY k)"""

_ORDER_LINES = """
f AS (SELECT o_orderkey, o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 17 = 0 THEN 'many' ELSE o_custkey::VARCHAR END AS b,
             o_orderstatus AS c, (o_orderkey % 5)::VARCHAR AS d, o_custkey FROM orders),
l AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'short' WHEN o_orderkey % 13 = 0 THEN 'long' WHEN o_orderkey % 17 = 0 THEN 'type' END AS reason FROM f)"""


def all_sql() -> dict[str, str]:
    pairs = "(SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    half = f"SELECT label FROM embeddings WHERE {oracle._u('vec_id')} >= 0.5"
    return {
        "compiled_scores": """SELECT unnest(['poisson', 'logistic', 'rf', 'gbt', 'mlp']) AS model, n, 0::BIGINT AS mismatches
            FROM (SELECT count(*) AS n FROM embeddings)""",
        "mlp_layers": "SELECT count(*) AS n, 0::BIGINT AS mismatches FROM embeddings",
        "boosting_prefixes": f"""SELECT unnest([0, 1, 2, 3])::INTEGER AS grid_index, n_pos, n_neg, true AS same FROM (
            SELECT count(*) FILTER (WHERE label >= 5) AS n_pos, count(*) FILTER (WHERE label < 5) AS n_neg FROM ({half}))""",
        "score_equations": """SELECT unnest(['logistic_0.0', 'logistic_0.2', 'logistic_0.5', 'logistic_0.8', 'logistic_1.0', 'poisson']) AS model,
                   n AS n_coefficients, 0::BIGINT AS violations FROM (
            SELECT count(DISTINCT l_returnflag) + count(DISTINCT p_brand) + count(DISTINCT p_type) - 3 AS n
            FROM lineitem JOIN part ON l_partkey = p_partkey)""",
        "als_normal_equations": f"SELECT count(DISTINCT o_custkey) AS n_users, 0::BIGINT AS mismatches FROM {pairs}",
        "kmeans_conditions": f"""SELECT count(DISTINCT l_partkey)::BIGINT AS n, 0::BIGINT AS not_nearest, 0::BIGINT AS centres_off
            FROM {pairs}""",
        "auc_grid": f"WITH {_AUC} SELECT grid_index, k, mean_metric, std_metric FROM g",
        "auc_best": f"WITH {_AUC} SELECT grid_index, k, mean_metric FROM g ORDER BY mean_metric DESC, grid_index LIMIT 1",
        "string_index_wide": """WITH c AS (SELECT o_custkey::VARCHAR AS customer, count(*) AS n FROM orders GROUP BY 1),
            i AS (SELECT customer, (row_number() OVER (ORDER BY n DESC, customer) - 1)::BIGINT AS customer_index FROM c)
            SELECT o_orderkey, customer, customer_index FROM orders JOIN i ON o_custkey::VARCHAR = customer""",
        "scan_log_text": oracle.all_sql()["class_counts"],
        "scan_orders": f"""WITH {_ORDER_LINES} SELECT o_orderkey, o_custkey, c AS o_orderstatus, d::INTEGER AS o_shippriority
            FROM l WHERE reason IS NULL""",
        "scan_quarantine": f"""WITH {_ORDER_LINES} SELECT CASE reason WHEN 'short' THEN concat_ws(',', a, b, c)
                WHEN 'long' THEN concat_ws(',', a, b, c, d, 'more') ELSE concat_ws(',', a, b, c, d) END AS record, reason
            FROM l WHERE reason IS NOT NULL""",
        "scan_headerless": """SELECT count(*) FILTER (WHERE vec_id % 9 <> 0) AS n,
                   (sum(CASE WHEN label >= 5 THEN 1 ELSE -1 END) FILTER (WHERE vec_id % 9 <> 0))::BIGINT AS labels,
                   round(sum(list_sum(embedding::DOUBLE[])) FILTER (WHERE vec_id % 9 <> 0), 6) AS total,
                   max(len(embedding))::INTEGER AS n_features, count(*) FILTER (WHERE vec_id % 9 = 0) AS n_bad FROM embeddings""",
        "appended_runs": f"""WITH x AS (SELECT {oracle._u('vec_id', salt=oracle.SAMPLE_SALT)} AS u, unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS f FROM embeddings)
            SELECT CASE WHEN f < 0.5 THEN 'a' ELSE 'b' END AS run_id, f AS sample_size, count(*) FILTER (WHERE u < f) AS sample_count,
                   f * 100.0::DOUBLE AS sample_size_percent FROM x GROUP BY f""",
    }
