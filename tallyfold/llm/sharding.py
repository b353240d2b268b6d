"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers 0 .. n-1 that depend on their content alone, the permutation moves the
number, and shard and slot are the remainder and the quotient of the moved number by the shard count. So
the place of every row can be computed from its number, the row count and the seed.

The halves of the Feistel network are residues modulo a = ceil(sqrt(n)) and b = ceil(n / a): its domain
exceeds n by less than a, and rows whose image falls outside walk the cycle until it is inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A Mersenne prime; products of two residues fit in a long.
PRIME = 2147483647

#: Rows are numbered within so many buckets; their counts are the only thing that is broadcast.
BUCKETS = 4096

#: (multiplier, addend, addend after squaring) of each round.
ROUND_KEYS = (
    (1103515245, 12345, 362437069),
    (1664525, 1013904223, 521288629),
    (22695477, 88675123, 123456789),
    (69069, 1234567, 987654321),
    (1566083941, 7654321, 192837465),
    (134775813, 5318008, 271828182),
)

#: A walk of more steps raises; each step's chance is about 1 / sqrt(n), and no walk outgrows a.
LONGEST_WALK = 64


def bucket_sql(key: str) -> str:
    """The bucket of an integer key, in SQL."""
    residue = f"((cast({key} as bigint) % {PRIME} + {PRIME}) % {PRIME})"
    return f"(({residue} * 48271) % {PRIME} % {BUCKETS})"


def round_sql(half: str, i: int, seed: int) -> tuple[str, str]:
    """Round i's function of a half: the linear step, and the square of its result `_tf_t`, taken apart."""
    times, plus, then = ROUND_KEYS[i]
    return f"(({half}) * {times} + {(plus + seed) % PRIME}) % {PRIME}", f"((_tf_t * _tf_t + {then}) % {PRIME})"


def _pass_sql(x: str, seed: int) -> str:
    """One pass of the permutation as one expression; `_tf_t` is bound by a lambda, so that it's computed once."""
    left, right = f"({x} div _tf_b)", f"({x} % _tf_b)"
    for i in range(len(ROUND_KEYS)):
        linear, square = round_sql(left if i % 2 else right, i, seed)
        mixed = f"element_at(transform(array({linear}), _tf_t -> {square}), 1)"
        if i % 2:
            right = f"(({right} + {mixed}) % _tf_b)"
        else:
            left = f"(({left} + {mixed}) % _tf_a)"
    return f"({left} * _tf_b + {right})"


def number_rows(df: DataFrame, key: str, order: list[str], name: str = "row_number") -> DataFrame:
    """df with gapless global row numbers from 0, by the bucket of key and then by order.

    Nothing is sorted across buckets: each bucket is numbered on its own and starts where the counts of the
    buckets before it end. There are at most BUCKETS counts, so they are broadcast. Also adds
    ``<name>_rows``, the number of all rows.
    """
    bucket, rows = f"{name}_bucket", f"{name}_rows"
    df = df.withColumn(bucket, F.expr(bucket_sql(key)))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(bucket).agg(F.count("*").alias("_tf_n"))
    starts = counts.select(
        bucket,
        F.coalesce(F.sum("_tf_n").over(before), F.lit(0)).alias("_tf_start"),
        F.sum("_tf_n").over(Window.partitionBy()).alias(rows),
    )
    within = Window.partitionBy(bucket).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        df.withColumn(name, F.row_number().over(within) - 1)
        .join(F.broadcast(starts), bucket)
        .withColumn(name, F.col(name) + F.col("_tf_start"))
        .drop(bucket, "_tf_start")
    )


def permute(df: DataFrame, number: str, rows: str, seed: int, name: str) -> DataFrame:
    """df with the image of a row number under the permutation of 0 .. rows-1.

    The first pass is compiled; the walk of the few rows whose first image is outside is an aggregate.
    """
    df = df.withColumn("_tf_a", F.expr(f"cast(ceil(sqrt(cast({rows} as double))) as bigint)"))
    df = df.withColumn("_tf_b", F.expr(f"({rows} + _tf_a - 1) div _tf_a"))
    df = df.withColumn("_tf_left", F.expr(f"{number} div _tf_b")).withColumn("_tf_right", F.expr(f"{number} % _tf_b"))
    for i in range(len(ROUND_KEYS)):
        to, by, modulus = ("_tf_right", "_tf_left", "_tf_b") if i % 2 else ("_tf_left", "_tf_right", "_tf_a")
        linear, square = round_sql(by, i, seed)
        df = df.withColumn("_tf_t", F.expr(linear)).withColumn(to, F.expr(f"({to} + {square}) % {modulus}"))
    df = df.withColumn("_tf_image", F.expr("_tf_left * _tf_b + _tf_right"))
    step = f"(at, _tf_step) -> if(at < {rows}, at, {_pass_sql('at', seed)})"
    walk = f"aggregate(sequence(1, {LONGEST_WALK}), _tf_image, {step})"
    df = df.withColumn(name, F.expr(f"if(_tf_image < {rows}, _tf_image, {walk})"))
    return df.drop("_tf_a", "_tf_b", "_tf_left", "_tf_right", "_tf_t", "_tf_image")


def shard_rows(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    order: list[str] | None = None,
    seed: int = 1,
) -> DataFrame:
    """df with ``shard`` and ``slot``: shards' counts are at most one apart, slots are gapless from 0.

    key: SQL of an integer that spreads the rows over buckets; it may not be null. order: columns that
    break ties within a bucket, nulls last; rows that agree in all of them are interchangeable. The same
    rows get the same places whatever files or partitions they come in. Extra columns stay; columns named
    shard or slot are replaced. An empty table gives an empty result.
    """
    placed = number_rows(df.drop("shard", "slot"), key, order or [key], "_tf_row")
    inside = F.col("_tf_moved") < F.col("_tf_row_rows")
    return (
        permute(placed, "_tf_row", "_tf_row_rows", seed, "_tf_moved")
        .withColumn("_tf_moved", F.when(inside, F.col("_tf_moved")).otherwise(F.raise_error(F.lit("walk too long"))))
        .withColumn("shard", (F.col("_tf_moved") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_tf_moved div {shards}"))
        .drop("_tf_row", "_tf_row_rows", "_tf_moved")
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """The place of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: groups of equal texts are spread, as counts at most one apart require. size is the
    text's UTF-8 bytes plus 1 (null text: 1, and the crc32 of no bytes, 0). A null doc_id is numbered by
    its text's crc32. Repeated rows get places of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, shards, "coalesce(doc_id, text_crc32)", ["doc_id", "text_crc32", "size"], seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, its rows in slot order."""
    (
        sharded.repartition(F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
