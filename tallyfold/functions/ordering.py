"""Sort orders with nulls last in either direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nulls_last(column: Column | str, descending: bool = False) -> Column:
    found = F.col(column) if isinstance(column, str) else column
    return found.desc_nulls_last() if descending else found.asc_nulls_last()


def order_sql(expression: str, descending: bool = False) -> str:
    return f"{expression} {'DESC' if descending else 'ASC'} NULLS LAST"
