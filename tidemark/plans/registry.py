"""All registered queries of the library but for the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detail_queries, grid_queries, palette_queries, pixel_queries, refine_queries, scalar_queries, source_queries, stream_queries, table_queries
from .standins import oracle

ALL = scalar_queries.QUERIES | table_queries.QUERIES | pixel_queries.QUERIES | stream_queries.QUERIES | grid_queries.QUERIES | refine_queries.QUERIES | palette_queries.QUERIES | detail_queries.QUERIES | source_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in ALL.items() if sql}
