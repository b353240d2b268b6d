"""Scalar subqueries: a value that one aggregate gives, beside every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, source: DataFrame, aggregate: Column, name: str) -> DataFrame:
    """df with a column that holds an aggregate of source; its one row is broadcast."""
    return df.crossJoin(F.broadcast(source.agg(aggregate.alias(name))))


def compared_with(df: DataFrame, condition: str, source: DataFrame, aggregate: Column) -> DataFrame:
    """Rows of df that meet a condition in which ``scalar`` is an aggregate of source."""
    return beside(df, source, aggregate, "scalar").where(condition).drop("scalar")
