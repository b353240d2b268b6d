"""Division and remainder that give 0 for a zero divisor and null if either side is null.

Spark raises for both; the guards keep expressions inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, y))


def safe_mod(a: Column, b: Column) -> Column:
    """a % b with the sign of a."""
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(0)).otherwise(F.try_mod(a, b))


def safe_div_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"
    )


def safe_mod_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN ({b}) = 0 THEN 0 ELSE try_mod({a}, {b}) END"
