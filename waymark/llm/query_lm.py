"""Query of language-model scores, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.lm import score_corpus
from waymark.llm.registry import query, table

#: Least counts of the pairs and triples that the trie keeps: all that occur.
LEAST_COUNTS = (1, 1)


@query()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), LEAST_COUNTS)
