"""DuckDB twins of the registered queries (the correctness gate).

Each string runs in DuckDB against views named after the driver tables. The
stand-in inputs of ``quarry.sources.standins`` are rebuilt here from the same
fixed values, so the Spark side and the SQL side read identical data.
"""

from __future__ import annotations

from quarry.sources.standins import (
    DASH_BYTES_EVERY, GARBAGE_EVERY, HOST_SUFFIXES, LOG_TZ_SUFFIX, NOT_MODIFIED_EVERY, ORG_MODULUS,
)


def _suffix_case() -> str:
    arms = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(HOST_SUFFIXES))
    return f"CASE user_id % {len(HOST_SUFFIXES)} {arms} END"


LOG_LINES = f"""
log_lines AS (
  SELECT CASE WHEN event_id % {GARBAGE_EVERY} = 0 THEN 'garbage' ELSE
    'h' || user_id::VARCHAR || '.uni' || (user_id % {ORG_MODULUS})::VARCHAR || {_suffix_case()}
    || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' {LOG_TZ_SUFFIX}] "GET /' || event_type
    || ' HTTP/1.0" '
    || CASE WHEN event_type = 'error' THEN '404' WHEN event_id % {NOT_MODIFIED_EVERY} = 0 THEN '304' ELSE '200' END
    || ' ' || CASE WHEN event_id % {DASH_BYTES_EVERY} = 0 THEN '-' ELSE ((event_id * 37) % 5000)::VARCHAR END
  END AS value
  FROM events
)"""

# The field patterns of a log line, as in functions.logparse.
PARSED = LOG_LINES + r""",
parsed0 AS (
  SELECT regexp_extract(value, '^(.*) - -.*', 1) AS host,
         regexp_extract(value, '.* - - \[(.*?)\].*', 1) AS "timestamp",
         regexp_extract(value, '.*"(.*)".*', 1) AS request,
         TRY_CAST(list_extract(string_split(value, ' '), -2) AS INTEGER) AS reply_code,
         TRY_CAST(list_extract(string_split(value, ' '), -1) AS INTEGER) AS reply_bytes
  FROM log_lines
),
parsed AS (
  SELECT *, TRY_CAST(regexp_extract("timestamp", '(\d+)/\w+/\d+', 1) AS INTEGER) AS day,
            TRY_CAST(regexp_extract("timestamp", '\d+/\w+/\d+:(\d+):', 1) AS INTEGER) AS hour
  FROM parsed0
)"""

ORGS = PARSED + r""",
classified AS (
  SELECT *, CASE WHEN ends_with(host, '.edu') THEN 'US' WHEN ends_with(host, '.ac.uk') THEN 'UK'
                 WHEN ends_with(host, '.edu.au') THEN 'AUS' END AS country_code
  FROM parsed
),
orgs AS (
  SELECT *, CASE country_code WHEN 'US' THEN regexp_extract(host, '([^.]+)\.edu', 1)
                              WHEN 'UK' THEN regexp_extract(host, '([^.]+)\.ac\.uk', 1)
                              WHEN 'AUS' THEN regexp_extract(host, '([^.]+)\.edu\.au', 1) END AS institution
  FROM classified WHERE country_code IN ('US', 'UK', 'AUS')
),
org_counts AS (
  SELECT country_code, institution, count(*) AS count FROM orgs
  WHERE institution IS NOT NULL GROUP BY 1, 2
),
class_totals AS (SELECT country_code, count(*) AS count FROM orgs GROUP BY 1),
org_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY count DESC, institution) AS rank
  FROM org_counts
)"""


def weblog_sql() -> dict[str, str]:
    return {
        "log_parse": f"WITH {PARSED} SELECT host, \"timestamp\", request, reply_code, reply_bytes, day, hour FROM parsed",
        "class_counts": f"WITH {ORGS} SELECT country_code, count FROM class_totals",
        "stream_class_counts": f"WITH {ORGS} SELECT country_code, count FROM class_totals",
        "class_counts_edu": f"""WITH {ORGS}, k AS (SELECT unnest(['US', 'UK', 'AUS']) AS country_code)
            SELECT country_code, count(host)::BIGINT AS count FROM k
            LEFT JOIN (SELECT * FROM orgs WHERE country_code = 'US') USING (country_code) GROUP BY 1""",
        "org_distinct": f"WITH {ORGS} SELECT country_code, count(DISTINCT institution) AS n_institutions "
                        f"FROM orgs GROUP BY 1",
        "org_topn": f"WITH {ORGS} SELECT country_code, institution, count, rank FROM org_ranked WHERE rank <= 9",
        "org_rank": f"""WITH {ORGS}, t AS (SELECT country_code, count AS t_count FROM org_counts WHERE institution = 'uni5')
            SELECT c.country_code, 'uni5' AS institution, t.t_count AS count,
                   (sum(CASE WHEN c.count > t.t_count OR (c.count = t.t_count AND c.institution < 'uni5')
                             THEN 1 ELSE 0 END) + 1)::INTEGER AS position,
                   (sum(CASE WHEN c.count > t.t_count THEN 1 ELSE 0 END) + 1)::INTEGER AS rank
            FROM org_counts c JOIN t USING (country_code) GROUP BY c.country_code, t.t_count""",
        "org_rank_uk": f"""WITH {ORGS}, c AS (SELECT * FROM org_counts WHERE country_code = 'UK'),
            t AS (SELECT country_code, count AS t_count FROM c WHERE institution = 'uni9')
            SELECT c.country_code, 'uni9' AS institution, t.t_count AS count,
                   (sum(CASE WHEN c.count > t.t_count OR (c.count = t.t_count AND c.institution < 'uni9')
                             THEN 1 ELSE 0 END) + 1)::INTEGER AS position,
                   (sum(CASE WHEN c.count > t.t_count THEN 1 ELSE 0 END) + 1)::INTEGER AS rank
            FROM c JOIN t USING (country_code) GROUP BY c.country_code, t.t_count""",
        "org_share": f"""WITH {ORGS},
            top AS (SELECT country_code, institution, count, rank FROM org_ranked WHERE rank <= 9),
            others AS (SELECT t.country_code, 'Others' AS institution,
                              t.count - coalesce((SELECT sum(count) FROM top WHERE top.country_code = t.country_code), 0) AS count,
                              10 AS rank FROM class_totals t),
            shares AS (SELECT * FROM top UNION ALL SELECT * FROM others)
            SELECT s.country_code, s.institution, s.count::BIGINT AS count, s.rank,
                   s.count::DOUBLE / t.count::DOUBLE * 100.0 AS pct
            FROM shares s JOIN class_totals t USING (country_code)""",
        "hour_grid": f"""WITH {ORGS},
            top1 AS (SELECT country_code, institution FROM org_ranked WHERE rank = 1),
            cells0 AS (SELECT country_code, institution, unnest(range(0, 744)) AS i FROM top1),
            cells AS (SELECT country_code, institution, i // 24 + 1 AS day, i % 24 AS hour FROM cells0),
            obs AS (SELECT country_code, institution, day, hour, count(*) AS count FROM orgs
                    WHERE day BETWEEN 1 AND 31 AND hour BETWEEN 0 AND 23 GROUP BY ALL)
            SELECT c.country_code, c.institution, c.day::INTEGER AS day, c.hour::INTEGER AS hour,
                   coalesce(o.count, 0)::BIGINT AS count
            FROM cells c LEFT JOIN obs o USING (country_code, institution, day, hour)""",
    }


def all_sql() -> dict[str, str]:
    out = {}
    out.update(weblog_sql())
    out.update(analytics_sql())
    out.update(ml_plumbing_sql())
    out.update(model_sql())
    return out


SEED_SALT = "#31891"


SAMPLE_SALT = "#31891-sample"


def _u(*exprs: str, salt: str = SEED_SALT) -> str:
    """DuckDB twin of ``functions.hashing.unit_interval`` (salted)."""
    key = " || '#' || ".join(f"{e}::VARCHAR" for e in exprs)
    return f"(('0x' || substr(md5({key} || '{salt}'), 1, 7))::BIGINT / 268435456.0)"


def _bucket(k: int, *exprs: str) -> str:
    key = " || '#' || ".join(f"{e}::VARCHAR" for e in exprs)
    return f"((('0x' || substr(md5({key} || '{SEED_SALT}'), 1, 7))::BIGINT % {k})::INTEGER)"


PART_ENC = """
brand_idx AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::INTEGER AS p_brand_index,
                     count(*) OVER () AS n_brands FROM part GROUP BY p_brand),
type_idx AS (SELECT p_type, (row_number() OVER (ORDER BY count(*) DESC, p_type) - 1)::INTEGER AS p_type_index,
                    count(*) OVER () AS n_types FROM part GROUP BY p_type),
enc AS (SELECT p.*, b.p_brand_index, b.n_brands, t.p_type_index, t.n_types
        FROM part p JOIN brand_idx b USING (p_brand) JOIN type_idx t USING (p_type))"""

LI_PRED = f"""
li AS (SELECT {_bucket(4, 'l_orderkey')} AS fold, l_quantity, l_extendedprice FROM lineitem),
preds AS (SELECT 0 AS grid_index, 'm1' AS model, fold, l_quantity, l_extendedprice / 2000.0 AS prediction FROM li
          UNION ALL SELECT 1, 'm2', fold, l_quantity, l_extendedprice / 1500.0 FROM li
          UNION ALL SELECT 2, 'm3', fold, l_quantity, 25.5 FROM li),
fm AS (SELECT grid_index, model, fold, count(*) AS n,
              sqrt(avg((prediction - l_quantity) * (prediction - l_quantity))) AS rmse
       FROM preds GROUP BY ALL)"""

EMB_SCORES = """
ix AS (SELECT (label >= 5)::INTEGER AS y, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings),
sc AS (SELECT y, 'e' || k::VARCHAR AS model, embedding[k + 1]::DOUBLE AS score FROM ix)"""

PROFILE = """
rel AS (SELECT l_partkey::INTEGER AS movieId, (l_suppkey % 25)::INTEGER AS tagId, round(avg(l_discount), 6)::DECIMAL(10,6) AS relevance
        FROM lineitem GROUP BY ALL),
cl AS (SELECT p_partkey::INTEGER AS id, (p_size % 19)::INTEGER AS cluster FROM part),
sizes AS (SELECT cluster, count(*) AS count FROM cl GROUP BY 1),
topc AS (SELECT cluster FROM sizes ORDER BY count DESC, cluster LIMIT 3),
ct0 AS (SELECT cl.cluster, rel.tagId, sum((rel.relevance * 1000000)::BIGINT)::HUGEINT AS micros,
               count(*)::HUGEINT AS n, count(*) FILTER (WHERE rel.relevance > 0.05) AS n_items
        FROM cl JOIN rel ON cl.id = rel.movieId WHERE cl.cluster IN (SELECT cluster FROM topc) GROUP BY ALL),
-- Spark's avg(DECIMAL(10,6)) is DECIMAL(14,10), rounded half-up; rounding that to 6 places is half-up again
ct AS (SELECT *, (2 * micros * 10000 + n) // (2 * n) AS avg_e10 FROM ct0),
r AS (SELECT *, ((2 * avg_e10 + 10000) // 20000)::DOUBLE / 1000000.0 AS avg_relevance,
             row_number() OVER (PARTITION BY cluster ORDER BY avg_e10 DESC, tagId) AS rank FROM ct),
prof AS (SELECT r.*, n.n_name AS tag FROM r JOIN nation n ON n.n_nationkey = r.tagId WHERE rank <= 3)"""


def analytics_sql() -> dict[str, str]:
    u_doc = _u("doc_id")
    return {
        "url_host_topn": r"""WITH h AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS host FROM pages),
            c AS (SELECT regexp_extract(host, '\.([A-Za-z0-9-]+)$', 1) AS tld, host, count(*) AS count FROM h GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY tld ORDER BY count DESC, host) AS rank FROM c)
            SELECT tld, host, count, rank FROM r WHERE rank <= 5""",
        "multi_sort": "SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL "
                      "ORDER BY o_orderpriority, count DESC",
        "topk": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3",
        "strat_split": f"SELECT CASE WHEN {u_doc} < 0.8 THEN 'train' ELSE 'test' END AS split, quality, "
                       f"count(*) AS count FROM labels GROUP BY ALL",
        "split_complement": f"SELECT * FROM labels EXCEPT SELECT * FROM labels WHERE {u_doc} < 0.8",
        "class_dist": f"""SELECT event_type, 'all' AS part, count(*) AS count FROM events GROUP BY 1
            UNION ALL SELECT event_type, 'sample', count(*) FILTER (WHERE {_u('event_id', salt=SAMPLE_SALT)} < 0.1) FROM events GROUP BY 1""",
        "kfold_sizes": f"SELECT {_bucket(4, 'l_orderkey', 'l_linenumber')} AS fold, count(*) AS count "
                       f"FROM lineitem GROUP BY 1",
        "sample_sizes": f"""WITH wb AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE -1 END AS label,
                                               {_u('vec_id', salt=SAMPLE_SALT)} AS u FROM embeddings),
            x AS (SELECT label, u, unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS fraction FROM wb)
            SELECT label, fraction, count(*) FILTER (WHERE u < fraction) AS count FROM x GROUP BY ALL""",
        "recode_binary": "SELECT o_orderkey, o_orderstatus, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::INTEGER "
                         "AS label FROM orders",
        "recode_sign": """SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE -1 END AS label_pm,
                                 CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings""",
        "string_index": f"WITH {PART_ENC} SELECT p_partkey, p_brand, p_brand_index, p_type, p_type_index FROM enc",
        "one_hot": f"""WITH {PART_ENC} SELECT p_partkey, p_brand_index AS brand_hot, n_brands::INTEGER AS brand_width,
                              p_type_index AS type_hot, n_types::INTEGER AS type_width, 2.0 AS ones FROM enc""",
        "assemble": f"""WITH {PART_ENC} SELECT p_partkey, (2 + n_brands)::INTEGER AS width, p_size::DOUBLE AS x0,
                               p_retailprice AS x1, p_brand_index AS hot_pos FROM enc""",
        "standardize": """SELECT p_partkey,
                round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z_price,
                round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_size FROM part""",
        "rmse_mae": f"""SELECT {_bucket(4, 'l_orderkey')} AS fold, count(*) AS n,
                round(sqrt(avg((l_extendedprice / 2000.0 - l_quantity) * (l_extendedprice / 2000.0 - l_quantity))), 6) AS rmse,
                round(avg(abs(l_extendedprice / 2000.0 - l_quantity)), 6) AS mae
            FROM lineitem GROUP BY 1""",
        "accuracy": f"""WITH {EMB_SCORES} SELECT model, count(*) AS n,
                round(avg(CASE WHEN y = (score > 0)::INTEGER THEN 1.0 ELSE 0.0 END), 6) AS accuracy
            FROM sc GROUP BY 1""",
        "auc_exact": f"""WITH {EMB_SCORES},
            ps AS (SELECT model, score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY ALL),
            cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ps)
            SELECT model, round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc,
                   sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM cum GROUP BY 1""",
        "fold_summary": f"""WITH {LI_PRED}
            SELECT grid_index, model,
                   round(max(rmse) FILTER (WHERE fold = 0), 6) AS rmse_fold0,
                   round(max(rmse) FILTER (WHERE fold = 1), 6) AS rmse_fold1,
                   round(max(rmse) FILTER (WHERE fold = 2), 6) AS rmse_fold2,
                   round(max(rmse) FILTER (WHERE fold = 3), 6) AS rmse_fold3,
                   round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std
            FROM fm GROUP BY ALL""",
        "best_param": f"""WITH {LI_PRED}, m AS (SELECT grid_index, model, avg(rmse) AS rmse_mean FROM fm GROUP BY ALL)
            SELECT grid_index, model, round(rmse_mean, 6) AS rmse_mean FROM m
            ORDER BY rmse_mean, grid_index LIMIT 1""",
        "top_clusters": f"WITH {PROFILE} SELECT s.cluster, s.count FROM sizes s JOIN topc USING (cluster)",
        "cluster_top_tags": f"WITH {PROFILE} SELECT cluster, tagId, tag, avg_relevance, rank FROM prof",
        "cluster_tag_counts": f"WITH {PROFILE} SELECT cluster, tagId, tag, n_items FROM prof",
    }


FLAGGED = """
flagged AS (SELECT (l_linestatus <> 'F')::INTEGER::DOUBLE AS flag,
                   (l_quantity + 20 * (l_linestatus <> 'F')::INTEGER > 30)::INTEGER AS y FROM lineitem)"""
FOLD_SALT_SQL = "#31891-cv"
BRANDS = """
enc AS (SELECT p_brand, l_quantity::DOUBLE AS q, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS y, l_orderkey, l_linenumber
        FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def model_sql() -> dict[str, str]:
    """Models whose answers have a closed form."""
    fold = f"(('0x' || substr(md5(l_orderkey::VARCHAR || '#' || l_linenumber::VARCHAR || '{FOLD_SALT_SQL}'), 1, 7))::BIGINT % 3)"
    return {
        "strat_sample": f"""WITH c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i
                                      FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))
            SELECT event_type, count(*) AS count FROM events JOIN c USING (event_type)
            WHERE {_u('event_id', salt=SAMPLE_SALT)} < 0.1::DOUBLE * i GROUP BY 1""",
        "wide_sample_share": f"""WITH train AS (SELECT {_u('vec_id', salt=SAMPLE_SALT)} AS u FROM embeddings
                                               WHERE {_u('vec_id')} < 0.8)
            SELECT count(*) AS n_all, count(*) FILTER (WHERE u < 0.5) AS n_sample,
                   round(100.0::DOUBLE * count(*) FILTER (WHERE u < 0.5) / count(*), 6) AS percent FROM train""",
        "poisson_means": f"WITH {BRANDS} SELECT p_brand, round(avg(q), 4) AS prediction FROM enc GROUP BY 1",
        "logistic_shares": f"WITH {BRANDS} SELECT p_brand, round(avg(y::DOUBLE), 4) AS probability FROM enc GROUP BY 1",
        "poisson_fold_metrics": f"""WITH {BRANDS}, f AS (SELECT *, {fold} AS fold FROM enc),
            k AS (SELECT unnest([0, 1, 2]) AS held),
            m AS (SELECT held, p_brand, avg(q) AS m FROM f JOIN k ON fold <> held GROUP BY ALL),
            e AS (SELECT held, sqrt(avg((q - m) * (q - m))) AS rmse
                  FROM f JOIN m ON f.fold = m.held AND f.p_brand = m.p_brand GROUP BY 1)
            SELECT 0::INTEGER AS grid_index, 0.0::DOUBLE AS regParam, round(avg(rmse), 4) AS mean_metric,
                   round(stddev_pop(rmse), 4) AS std_metric FROM e""",
        "tree_shares": f"""WITH {FLAGGED} SELECT flag, round(avg(y::DOUBLE), 5) AS probability FROM flagged GROUP BY 1""",
        "boosted_signs": f"""WITH {FLAGGED}
            SELECT flag, CASE WHEN avg(y::DOUBLE) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM flagged GROUP BY 1""",
        "cluster_planted": """SELECT (p_size % 2)::INTEGER AS planted, count(*) AS count, 1::BIGINT AS n_clusters
            FROM part GROUP BY 1""",
        "als_dot_products": """SELECT count(*) AS n, 0::BIGINT AS mismatches FROM (
            SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        "fold_matrix": f"""WITH {LI_PRED} SELECT model, """ + ", ".join(
            f"round(max(rmse) FILTER (WHERE fold = {f}), 6) AS fold_{f}" for f in range(4)) + " FROM fm GROUP BY 1",
        "evaluator_table": f"""WITH {LI_PRED},
            x AS (SELECT model, sqrt(avg((prediction - l_quantity) * (prediction - l_quantity))) AS rmse,
                         avg(abs(prediction - l_quantity)) AS mae FROM preds GROUP BY 1)
            SELECT model, 'rmse' AS metric, round(rmse, 6)::DOUBLE AS value FROM x
            UNION ALL SELECT model, 'mae', round(mae, 6)::DOUBLE FROM x""",
        "scaling_report_counts": f"""WITH t AS (SELECT {_u('vec_id', salt=SAMPLE_SALT)} AS u FROM embeddings
                                                WHERE {_u('vec_id')} < 0.8),
            x AS (SELECT u, unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS f FROM t),
            s AS (SELECT f, count(*) FILTER (WHERE u < f) AS n FROM x GROUP BY 1),
            m AS (SELECT *, unnest([0, 1, 2]) AS i FROM s)
            SELECT f * 100.0::DOUBLE AS sample_size_percent, n AS sample_count, ['rf', 'gbt', 'mlp'][i + 1] AS model,
                   n::DOUBLE * (3 * i + 1) AS accuracy, n::DOUBLE * (3 * i + 2) AS auc, n::DOUBLE * (3 * i + 3) AS seconds,
                   round(1.0::DOUBLE / (3 * i + 3), 6) AS rows_per_second FROM m""",
        "fold_cluster_tags": FOLD_PROFILE + " SELECT fold, cluster, rank, tagId, tag, avg_relevance, n_items FROM prof",
    }


FOLD_PROFILE = """WITH
rel AS (SELECT l_partkey::INTEGER AS movieId, (l_suppkey % 25)::INTEGER AS tagId,
               round(avg(l_discount), 6)::DECIMAL(10,6) AS relevance FROM lineitem GROUP BY ALL),
p AS (SELECT p_partkey::INTEGER AS id, p_size, unnest([0, 1, 2, 3])::INTEGER AS fold FROM part),
cl AS (SELECT fold, id, ((p_size + fold) % 19)::INTEGER AS cluster FROM p),
sizes AS (SELECT fold, cluster, count(*) AS count FROM cl GROUP BY ALL),
topc AS (SELECT fold, cluster FROM sizes
         QUALIFY row_number() OVER (PARTITION BY fold ORDER BY count DESC, cluster) <= 3),
ct0 AS (SELECT cl.fold, cl.cluster, rel.tagId, sum((rel.relevance * 1000000)::BIGINT)::HUGEINT AS micros,
               count(*)::HUGEINT AS n, count(*) FILTER (WHERE rel.relevance > 0.05) AS n_items
        FROM cl JOIN topc USING (fold, cluster) JOIN rel ON cl.id = rel.movieId GROUP BY ALL),
ct AS (SELECT *, (2 * micros * 10000 + n) // (2 * n) AS avg_e10 FROM ct0),
r AS (SELECT *, ((2 * avg_e10 + 10000) // 20000)::DOUBLE / 1000000.0 AS avg_relevance,
             row_number() OVER (PARTITION BY fold, cluster ORDER BY avg_e10 DESC, tagId)::INTEGER AS rank FROM ct),
prof AS (SELECT r.*, n.n_name AS tag FROM r JOIN nation n ON n.n_nationkey = r.tagId WHERE rank <= 3)"""


def ml_plumbing_sql() -> dict[str, str]:
    """Deterministic parts of the ML analyses: sample sizes and scored-row counts."""
    wide_train = f"""wb AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
                            {_u('vec_id')} AS u_split, {_u('vec_id', salt=SAMPLE_SALT)} AS u_sample FROM embeddings),
        train AS (SELECT * FROM wb WHERE u_split < 0.8)"""
    return {
        "glm_split_dist": f"""SELECT CASE WHEN {_u('l_orderkey', 'l_linenumber')} < 0.8 THEN 'train' ELSE 'test' END AS split,
                   (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END)::INTEGER AS status_flag, count(*) AS count
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
        "wide_class_dist": f"""WITH {wide_train}
            SELECT 'all' AS part, label, count(*) AS count FROM train GROUP BY label
            UNION ALL SELECT 'sample', label, count(*) FROM train WHERE u_sample < 0.5 GROUP BY label""",
        "scaling_sizes": f"""WITH {wide_train},
            x AS (SELECT u_sample, unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS sample_size FROM train),
            s AS (SELECT sample_size, count(*) FILTER (WHERE u_sample < sample_size) AS sample_count FROM x GROUP BY 1)
            SELECT sample_size, sample_count, unnest(['rf', 'gbt', 'mlp']) AS model FROM s""",
        "glm_readout": """SELECT unnest(['poisson', 'logistic_l2', 'logistic_en']) AS model, unnest([6, 6, 30])::BIGINT AS n_points,
            true AS best_first""",
        "wide_readout": "SELECT unnest(['rf', 'gbt', 'mlp']) AS model, 27::BIGINT AS n_points, true AS best_first",
        "als_readout": f"""WITH r AS (SELECT o_custkey::INTEGER AS userId, l_partkey::INTEGER AS movieId
                          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
            f AS (SELECT *, {_bucket(4, 'userId', 'movieId')} AS fold FROM r),
            n AS (SELECT count(*) AS n FROM f t
                  WHERE EXISTS (SELECT 1 FROM f a WHERE a.fold <> t.fold AND a.userId = t.userId)
                    AND EXISTS (SELECT 1 FROM f b WHERE b.fold <> t.fold AND b.movieId = t.movieId))
            SELECT unnest([1, 2, 3]) AS model, 4::BIGINT AS n_folds, n AS n_scored, true AS same FROM n""",
        "rating_fold_sizes": f"""WITH r AS (SELECT o_custkey::INTEGER AS userId, l_partkey::INTEGER AS movieId
                          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
            SELECT {_bucket(4, 'userId', 'movieId')} AS fold, count(*) AS count FROM r GROUP BY 1""",
        "als_fold_counts": f"""WITH r AS (SELECT o_custkey::INTEGER AS userId, l_partkey::INTEGER AS movieId
                          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
            f AS (SELECT *, {_bucket(4, 'userId', 'movieId')} AS fold FROM r),
            n AS (SELECT t.fold, count(*) AS n FROM f t
                  WHERE EXISTS (SELECT 1 FROM f a WHERE a.fold <> t.fold AND a.userId = t.userId)
                    AND EXISTS (SELECT 1 FROM f b WHERE b.fold <> t.fold AND b.movieId = t.movieId)
                  GROUP BY t.fold)
            SELECT unnest([1, 2, 3]) AS model, fold, n FROM n""",
    }
