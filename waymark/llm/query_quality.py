"""Query of the quality rules, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.quality import judge_quality
from waymark.llm.registry import query, table


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
