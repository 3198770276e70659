"""Query of language identification, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.language import identify_languages
from waymark.llm.registry import query, table


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
