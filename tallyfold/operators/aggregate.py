"""Ungrouped aggregates: one row, whatever the input; of no rows all but counts are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, **aggregates: Column | str) -> DataFrame:
    """One row with the given aggregates, in one pass."""
    return df.agg(*[(F.expr(a) if isinstance(a, str) else a).alias(name) for name, a in aggregates.items()])


def money_sum(amount: Column) -> Column:
    """A sum of amounts of two decimals that doesn't depend on the order of rows, as a double."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")
