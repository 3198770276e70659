"""Query of source mixing, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.mixing import mix_sources
from waymark.llm.registry import query, table

SQL = """
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('mix:' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '-')
      || coalesce(':' || source, '')) || ':'
      || (row_number() OVER (PARTITION BY doc_id, text, source) - 1)) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS room,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sources),
levels AS (
  SELECT *, row_number() OVER fill AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(room) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      AS level
  FROM weighed
  WINDOW fill AS (ORDER BY room / weight, source NULLS LAST)),
chosen AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight < room),
targets AS (
  SELECT source, source_size,
    coalesce(least(room, (SELECT level FROM chosen) * weight), room) AS target
  FROM weighed),
running AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM sized),
cut AS (
  SELECT r.doc_id, r.size, r.before, t.source_size, t.target, floor(t.target)::BIGINT AS budget
  FROM running r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM cut
"""


@query(SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
