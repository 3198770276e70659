"""Query of periodic runs, over all documents."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.periods import periodic_runs, run_digests
from waymark.llm.registry import query, table


def repeated_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """For a tenth of the documents, repeat a part of the words up to the end."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(
        periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    )
