"""Projections: expressions, names and order of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def projection(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Columns of the given names, each an expression or SQL text."""
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def reversed_columns(df: DataFrame) -> DataFrame:
    return df.select(*df.columns[::-1])
