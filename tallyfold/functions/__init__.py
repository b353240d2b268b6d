"""Column helpers, each with a twin in SQL text."""

from tallyfold.functions.arithmetic import safe_div, safe_div_sql, safe_mod, safe_mod_sql
from tallyfold.functions.casts import (
    from_epoch,
    from_epoch_sql,
    plus_seconds,
    seconds_between,
    to_epoch,
    to_epoch_sql,
    truncated,
    truncated_sql,
)
from tallyfold.functions.ordering import nulls_last, order_sql

__all__ = [
    "from_epoch", "from_epoch_sql", "nulls_last", "order_sql", "plus_seconds", "safe_div", "safe_div_sql",
    "safe_mod", "safe_mod_sql", "seconds_between", "to_epoch", "to_epoch_sql", "truncated", "truncated_sql",
]
