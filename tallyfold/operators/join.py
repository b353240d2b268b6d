"""Inner joins and cross products. Spark picks the strategy; null keys join nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__,
    ">=": Column.__ge__,
}


def inner(left: DataFrame, right: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows of both sides that meet all conditions: left's columns, then right's."""
    on = F.lit(True)
    for c in conditions:
        on = on & (F.expr(c) if isinstance(c, str) else c)
    return left.join(right, on, "inner")


#: Rows of one key that each row of the other side meets at a time, pairs that one task makes, about, and tasks at most.
CHUNK, TASK_PAIRS, MOST_TASKS = 1000, 4_000_000, 4096


def equal_pairs(rows: DataFrame, key: str, *on: str) -> DataFrame:
    """a_key and b_key of all pairs of rows that agree in all columns on; key is their id.

    The pairs grow with the square of a group, and Spark, which knows only the rows, would make them in a few tasks.
    So there are as many tasks as the pairs need, and a large group is cut into chunks, each of which all its rows go by.
    """
    keys = [F.col(c) for c in on]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, math.ceil(pairs / TASK_PAIRS)))
    chunks = sizes.select(*keys, F.ceil(F.col("_n") / CHUNK).cast("long").alias("_chunks"))
    counted = rows.select(key, *keys).join(chunks, list(on))
    a = counted.select(*keys, F.col(key).alias("a_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))
    b = counted.select(*keys, F.col(key).alias("b_key"), F.pmod(F.xxhash64(key), "_chunks").alias("_chunk"))
    a, b = (side.repartition(tasks, *keys, "_chunk") for side in (a, b))
    return a.hint("merge").join(b, [*on, "_chunk"]).select("a_key", "b_key")


def theta(left: DataFrame, right: DataFrame, a: str, compare: str, b: str) -> DataFrame:
    """Rows of both sides whose columns a and b compare as told: = <> < <= > or >=.

    Any but = compares all pairs; the sides come as they are, so filter and narrow them first.
    """
    return left.join(right, _COMPARE[compare](left[a], right[b]), "inner")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)
