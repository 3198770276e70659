"""Query of personal data, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.private import KINDS, find_private
from waymark.llm.registry import query, table
from waymark.llm.spans import span_digests


@query()
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_private(table(spark, sf_dir, "documents")), KINDS)
