"""Registered queries: each takes (spark, data_dir) and returns a DataFrame.

Every query reads whole tables of the data directory (or tables Spark derives
from them). Column names and types match ``lumenvec.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenvec.plans.queries import embedding, reports, search, store, tokens
from lumenvec.plans.queries.embedding import q_embed_static
from lumenvec.plans.queries.fixtures import SUBWORD64, WORDS64, fixture_onnx, fixture_tasks

__all__ = ["QUERIES", "SUBWORD64", "WORDS64", "fixture_onnx", "fixture_tasks", "q_embed_static"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    tokens.QUERIES | embedding.QUERIES | search.QUERIES | reports.QUERIES | store.QUERIES
)
