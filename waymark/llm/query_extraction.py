"""Query of main-text extraction, over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.extraction import extract_pages
from waymark.llm.registry import query, table


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
