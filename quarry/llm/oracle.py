"""DuckDB twins of the queries of this part that SQL can express."""

from __future__ import annotations

OP11 = """
WITH taking_part AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, r.n, r.vec_id, r.label = a.label AS same,
         list_dot_product(a.v, r.v)::BIGINT AS score
  FROM taking_part a JOIN taking_part r ON r.n <> a.n WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positive p JOIN scored s
  ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP13 = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
whole AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM doc WHERE len(terms) > 0),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM doc) GROUP BY ALL),
item AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
use AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM item) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * max(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM use) GROUP BY term),
scored AS (
  SELECT i, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(doc.terms) * n) // l))))::BIGINT AS score
  FROM use JOIN weight USING (term) JOIN tf USING (term) JOIN doc USING (d), whole GROUP BY i, d)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored JOIN doc USING (d) JOIN item USING (i) WHERE score > 0
QUALIFY rank <= 20
"""


def all_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11, "op13_search": OP13}
