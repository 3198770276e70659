"""Query of secret scans, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.registry import query, table
from waymark.llm.secrets import RULES, find_secrets
from waymark.llm.spans import span_digests


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in RULES if r.base]
    return span_digests(find_secrets(table(spark, sf_dir, "documents")), kinds)
