"""Registered queries: each one a Spark plan and, where SQL can say it, its twin."""

from . import analysis, confirmation, explanation, points, profiling, scoring  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
