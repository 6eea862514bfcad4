"""Subtypes of a type, or else its implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subtypes(type_edges: DataFrame, types: DataFrame) -> DataFrame:
    """super, sub for one level below each of ``types`` (super)."""
    return type_edges.join(types, "super").select("super", "sub")


def distinct_lines(found: DataFrame) -> DataFrame:
    """One row for each (query, path, name): that of least line."""
    return found.groupBy("query_id", "path", "name").agg(F.min("line").alias("line"))


def with_fallback(first: DataFrame, second: DataFrame, key: str = "query_id") -> DataFrame:
    """The rows of ``first``, and for keys that have none those of ``second`` (as they are)."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
