"""What the two vector searches share: valid rows, blocks of queries, and the merge of partial results."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.session import bounded_batches, materialise, scratch

#: Bytes of query vectors that are broadcast at a time, about, and the queries that a block has at most.
BLOCK_BYTES, BLOCK_QUERIES = 16 << 20, 1 << 16

#: Vectors in one shard's tree or code table.
SHARD_ROWS = 8192


def usable(table: DataFrame, zero: bool = True, most: str = "double('infinity')") -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part.

    Left out are null ids, null or empty vectors, those with null or non-finite components or one of most and more,
    and zero vectors unless zero is set.
    """
    bounded_batches(table.sparkSession)
    finite = f"forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {most})"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    rows = rows.where(f"vec_id is not null and embedding is not null and size(embedding) > 0 and {finite}")
    return rows if zero else rows.where("exists(embedding, x -> x <> 0)")


def by_length(
    rows: DataFrame, queries: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], empty: str
) -> DataFrame:
    """search() among the rows and queries of each length of vector, put together: other lengths have no product."""
    size = F.size("embedding")
    lengths = sorted(r[0] for r in rows.select(size.alias("d")).distinct().collect())
    found = [search(rows.where(size == d), queries.where(size == d)) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], empty)


def as_matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Vectors of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def shards(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a partition's rows, in shards of at most the given number of rows."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held + part.num_rows > rows:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, held = [], [], 0
            if part.num_rows:
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vectors.append(as_matrix(part.column(1)))
                held += part.num_rows
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    return np.lexsort((ids, -scores))[:k]


def _packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "floor"))
            packed = pickle.dumps((ids, as_matrix(batch.column("embedding")), floor), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["packed"])


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors and floors of the queries (vec_id, embedding of one length, floor), in blocks of bounded bytes."""
    kept = materialise(queries, "queries")
    seen = kept.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    most = min(BLOCK_QUERIES, max(1, BLOCK_BYTES // (8 * max(1, seen["d"] or 1))))
    n = -(-seen["n"] // most)
    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, n)))
    for i in range(n):
        rows = kept.where(block == i).select("vec_id", "embedding", "floor").mapInArrow(_packed_queries, "packed binary")
        parts = [pickle.loads(r["packed"]) for r in rows.toLocalIterator()]
        if parts:
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def search_blocks(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    search: Callable[[Any], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]],
    schema: str,
    order: list[Column],
    extra: dict[str, Any] | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best that search finds, for one block of queries after the other.

    What is broadcast for a block are its ids, vectors and floors and the (bounded) extra; search(broadcast) goes
    over all rows of index and yields rows of schema: query (a query's place in the block), query_id, vec_id, score
    and what order needs. Each block's result is written before the next one starts; a block has some ten thousand
    queries, so there are few jobs.
    """
    spark: SparkSession = index.sparkSession
    path = scratch(spark, "found")
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    kept = ["query_id", "rank", "vec_id", "score"]
    empty = spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(*kept)
    empty.write.parquet(path)
    for ids, vectors, floor in query_blocks(queries):
        sent = spark.sparkContext.broadcast({"ids": ids, "queries": vectors, "floor": floor, **(extra or {})})
        found = index.mapInArrow(search(sent), schema).withColumn("rank", ranked)
        found.where(F.col("rank") <= k).select(*kept).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(empty.schema).parquet(path)
