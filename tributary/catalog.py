"""Importing this module registers the queries of the library's own operators."""

from __future__ import annotations

from .plans import diagnostic_queries, model_queries, predictive_queries, preprocess_queries, prior_queries, report_queries, score_queries, signature_queries, store_queries, tail_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
