"""Query of BPE encoding and decoding, over all documents."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.bpe import encode_documents
from waymark.llm.registry import query, table

TOKENIZER_FILE = Path(public_tokenizers.path("byte_bpe_50k.json"))


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), TOKENIZER_FILE))
