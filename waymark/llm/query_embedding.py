"""Query of near-duplicate vectors, over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.embedding import near_vectors
from waymark.llm.registry import query, table

SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach(vec_id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links,
  least(e.vec_id, coalesce(l.low, e.vec_id))::BIGINT AS component_id,
  e.vec_id <= coalesce(l.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c USING (vec_id) LEFT JOIN least l USING (vec_id)
"""


@query(SQL)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
