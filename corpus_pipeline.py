"""A training corpus from documents, in five stages.

Each stage works on all that the one before kept, is written as Parquet to the
shared folder and read again. Texts in no known language go, one document of
each group of near copies stays, personal data is masked, sources are mixed to
their target weights, and what is left is encoded for training.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.bpe import encode_documents
from waymark.llm.language import in_known_languages
from waymark.llm.minhash import one_of_each
from waymark.llm.mixing import mixed_documents
from waymark.llm.private import redacted
from waymark.llm.query_bpe import TOKENIZER_FILE
from waymark.llm.storage import written
from waymark.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return in_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, 80 % similarity; the smallest id of a group stays."""
    configure(spark)
    return one_of_each(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes once for each pass; a partial pass cuts its text."""
    configure(spark)
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return encode_documents(docs, TOKENIZER_FILE).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids"
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("minhash_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", source_mix),
    ("bpe", token_ids),
]

#: SQL can express neither the language profiles nor the token automaton.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
