"""Total orders, nulls last in either direction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyfold.functions.ordering import nulls_last


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """df in the order of all keys; a key that begins with - is descending."""
    return df.orderBy(*[nulls_last(k.removeprefix("-"), k.startswith("-")) for k in keys])
