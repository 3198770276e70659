"""Query of repeated passages, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.registry import query, table
from waymark.llm.substrings import without_repeats

SQL = """
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM cut)),
firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
covered AS (
  SELECT DISTINCT r, unnest(range(p, p + 13)) AS k
  FROM windows JOIN firsts USING (x) WHERE doc_id > first OR (doc_id IS NULL AND first IS NOT NULL)),
gone AS (SELECT r, list(k) AS ks FROM covered GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k])
  END, ' '), '')) AS kept_sha256
FROM cut LEFT JOIN gone USING (r)
"""


@query(SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
