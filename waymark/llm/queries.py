"""One query per operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from waymark.llm import (  # noqa: F401
    query_bpe,
    query_embedding,
    query_extraction,
    query_language,
    query_lm,
    query_merkle,
    query_minhash,
    query_mixing,
    query_periods,
    query_private,
    query_quality,
    query_secrets,
    query_substrings,
)
from waymark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
