"""Stand-in inputs derived from the driver tables (FIXTURES.md section C).

The analyses were recorded on public datasets that are not available here, so
each input shape is rebuilt from the TPC-H-like tables with plain Spark
expressions. Every builder reads whole tables, so its work grows with them,
and each has a DuckDB twin in ``quarry.oracle`` built from the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read_table, split_features_label

# Fixed values of the log-line stand-in (shared with the DuckDB twin).
# host: h<user_id>.uni<user_id % ORG_MODULUS> followed by a suffix chosen by user_id % 4
HOST_SUFFIXES = [".edu", ".ac.uk", ".edu.au", ".com"]
ORG_MODULUS = 13
GARBAGE_EVERY = 97       # every 97th event becomes the malformed line "garbage"
DASH_BYTES_EVERY = 5     # every 5th event logs "-" as its byte count
NOT_MODIFIED_EVERY = 11  # every 11th event answers 304
LOG_TZ_SUFFIX = "-0400"


def _suffix(user_id: Column) -> Column:
    expr = None
    for i, suffix in enumerate(HOST_SUFFIXES):
        cond = (user_id % len(HOST_SUFFIXES)) == i
        expr = F.when(cond, F.lit(suffix)) if expr is None else expr.when(cond, F.lit(suffix))
    return expr


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log text lines (``value STRING``) built from ``events``.

    ``h12.uni12.edu - - [01/Jan/2024:00:00:07 -0400] "GET /click HTTP/1.0" 200 444``
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".uni"),
                    (F.col("user_id") % ORG_MODULUS).cast("string"), _suffix(F.col("user_id")))
    code = F.when(F.col("event_type") == "error", F.lit("404")) \
            .when(F.col("event_id") % NOT_MODIFIED_EVERY == 0, F.lit("304")) \
            .otherwise(F.lit("200"))
    nbytes = F.when(F.col("event_id") % DASH_BYTES_EVERY == 0, F.lit("-")) \
              .otherwise(((F.col("event_id") * 37) % 5000).cast("string"))
    line = F.concat(host, F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
                    F.lit(f" {LOG_TZ_SUFFIX}] \"GET /"), F.col("event_type"),
                    F.lit(" HTTP/1.0\" "), code, F.lit(" "), nbytes)
    value = F.when(F.col("event_id") % GARBAGE_EVERY == 0, F.lit("garbage")).otherwise(line)
    return ev.select(value.alias("value"))


def embedding_width(emb: DataFrame) -> int:
    """Elements of every ``embedding`` (one bounded aggregate); rows of different widths are an error."""
    low, high = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"embeddings have {low} to {high} elements")
    return low or 0


def wide_features(wide: DataFrame, label_col: str = "label") -> list[str]:
    """The feature columns of ``wide_binary``, all between the key and the label."""
    features, _ = split_features_label([c for c in wide.columns if c != "vec_id"])
    return features


def wide_binary(spark: SparkSession, sf_dir: str, label_col: str = "label") -> DataFrame:
    """Wide binary table: numeric columns ``_c0, _c1, ...``, as many as the
    embeddings have elements, and a label in {-1, 1}.

    ``embeddings.label >= 5`` is the positive class. ``vec_id`` is kept as the
    row key for deterministic splits.
    """
    emb = read_table(spark, sf_dir, "embeddings")
    width = embedding_width(emb)
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"_c{i}") for i in range(width)]
    lab = F.when(F.col("label") >= 5, F.lit(1)).otherwise(F.lit(-1)).alias(label_col)
    return emb.select("vec_id", *cols, lab)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ratings ``(userId INT, movieId INT, rating FLOAT)``.

    A customer rates a part by the mean quantity over all their line items of
    it: ``lineitem`` joined to ``orders`` on the order key, averaged per pair.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return (joined.groupBy("o_custkey", "l_partkey")
                  .agg(F.avg("l_quantity").alias("rating"))
                  .select(F.col("o_custkey").cast("int").alias("userId"),
                          F.col("l_partkey").cast("int").alias("movieId"),
                          F.col("rating").cast("float").alias("rating")))


def relevance_scores(spark: SparkSession, sf_dir: str, n_tags: int = 25) -> DataFrame:
    """Item-tag relevance ``(movieId, tagId, relevance)`` from ``lineitem``.

    item = part key, tag = supplier key modulo the tag count, relevance = mean
    discount of the pair's line items (one row per pair), as DECIMAL(10,6)
    like published fixed-precision relevance scores: the value does not depend
    on the order a mean was summed in, and means over it are exact decimals.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    return (li.groupBy(F.col("l_partkey").cast("int").alias("movieId"),
                       (F.col("l_suppkey") % n_tags).cast("int").alias("tagId"))
              .agg(F.round(F.avg("l_discount"), 6).cast("decimal(10,6)").alias("relevance")))


def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag names ``(tagId, tag)`` from ``nation``."""
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("tagId"), F.col("n_name").alias("tag"))


def fixed_clusters(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A cluster assignment ``(id, cluster)`` that does not depend on a model fit."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("id"), (F.col("p_size") % k).cast("int").alias("cluster"))


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical encounters table: ``lineitem`` joined to ``part``.

    Categorical features ``l_returnflag, p_brand, p_type``; count label
    ``l_quantity`` (double); text label ``l_linestatus`` (``F``/``O``) to be
    recoded to 0/1. ``(l_orderkey, l_linenumber)`` is the row key (not unique).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (li.join(part, li.l_partkey == part.p_partkey, "inner")
              .select("l_orderkey", "l_linenumber", "l_returnflag", "p_brand", "p_type",
                      F.col("l_quantity").cast("double").alias("l_quantity"), "l_linestatus"))
