"""The registered queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import allocation, descriptions, forms, gates, goods, lookups, operations, pages, resolution, review, streams, text, weights

GROUPS = (allocation, weights, gates, resolution, lookups, operations, review, streams, text, forms, descriptions, pages, goods)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for group in GROUPS for name, (build, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
