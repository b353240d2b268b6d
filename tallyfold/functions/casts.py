"""Casts between numbers and datetimes, in whole seconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def truncated(x: Column) -> Column:
    """A number as INT, cut towards zero."""
    return x.cast("int")


def to_epoch(x: Column) -> Column:
    """Seconds of a datetime, as BIGINT; parts of a second are cut off towards the epoch."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), x)


def from_epoch(x: Column) -> Column:
    """The datetime of a number of seconds; a fraction is cut off first."""
    return F.timestamp_add("SECOND", x.cast("bigint"), F.expr(_EPOCH))


def truncated_sql(x: str) -> str:
    return f"CAST({x} AS INT)"


def to_epoch_sql(x: str) -> str:
    return f"timestampdiff(SECOND, {_EPOCH}, {x})"


def from_epoch_sql(x: str) -> str:
    return f"timestampadd(SECOND, CAST({x} AS BIGINT), {_EPOCH})"


def plus_seconds(x: Column, seconds: Column) -> Column:
    """A datetime and a whole number of seconds, which may be negative."""
    return F.timestamp_add("SECOND", seconds.cast("bigint"), x)


def seconds_between(x: Column, y: Column) -> Column:
    """Whole seconds from datetime x to datetime y."""
    return F.timestamp_diff("SECOND", x, y)
