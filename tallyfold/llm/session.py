"""What the operators need from a session: a shared scratch folder and bounded Arrow batches."""

from __future__ import annotations

import gc
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

Batches = Iterator[pa.RecordBatch]

#: Used only where a local session names no checkpoint folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"

#: Python stages get batches of at most so many rows and bytes, whatever the length of a text.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

#: Rows, and bytes on disk as well as unpacked, up to which small() broadcasts a table.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 24 << 20

#: Short rows in one partition of a table whose size is known beforehand.
FILE_ROWS = 250_000



class _Register(threading.local):
    """The scratch paths in use, of each thread its own: pipelines side by side don't delete each other's."""

    def __init__(self):
        self.paths: list[str] = []


_register = _Register()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master may go without: on a cluster a folder of the driver's machine isn't that of the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SCRATCH)
        found = LOCAL_SCRATCH
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Get a session ready for Python stages: workers find this package, and Arrow batches are bounded.

    Batches are bounded in rows and bytes, so that long texts don't fill a worker. Workers are told where the
    driver has the package; on a cluster it is there too, or comes with the job (--py-files).
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _register.paths.append(path)
    return path


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many short rows, in no more partitions than they need."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    rows: about how many short rows df has, where that is known; they are then written in no more files than
    they need.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = few(df, rows)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES.

    These are the bytes on disk and those in memory: lists that take little on disk are many times as large when the
    driver unpacks them. Beyond that it is joined by a shuffle; Spark, which knows the size on disk alone, isn't asked.
    """
    if bytes_on_disk(table) <= BROADCAST_BYTES:
        rows, size = table.agg(F.count("*"), F.sum(unpacked_bytes(table))).first()
        if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
            return F.broadcast(table)
    return table.hint("merge")


def unpacked_bytes(table: DataFrame) -> Column:
    """The bytes of a row of table as Spark has it in memory, about."""
    return F.lit(8) + sum((F.lit(_unpacked(F.col(f"`{f.name}`"), f.dataType)) for f in table.schema.fields), F.lit(0))


def _unpacked(value: Column, kind: DataType) -> Column | int:
    """The bytes of a value in such a row: eight, and those that they point to."""
    none = F.lit(0).cast("long")
    if isinstance(kind, (StringType, BinaryType)):
        return 8 + F.coalesce(F.octet_length(value), none)
    if isinstance(kind, StructType):
        return 16 + sum(_unpacked(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, MapType):
        keys, values = ArrayType(kind.keyType), ArrayType(kind.valueType)
        return 16 + _unpacked(F.map_keys(value), keys) + _unpacked(F.map_values(value), values)
    if isinstance(kind, ArrayType):
        if isinstance(each := _unpacked(F.lit(None), kind.elementType), int):
            return 24 + F.coalesce(F.array_size(value), none) * each
        return 24 + F.coalesce(F.aggregate(value, none, lambda n, x: n + _unpacked(x, kind.elementType)), none)
    return 8


def bytes_on_disk(table: DataFrame) -> int:
    """The size of the folder that a materialised table is in."""
    files = table.inputFiles()
    if not files:
        return 0
    context = table.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def dealt_join(rows: DataFrame, led: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join of rows with led (one row for each key, a whole number or text) on something made of the key.

    led comes out of its aggregation dealt by the key. Joined on it, it wouldn't be dealt again, and Spark splits
    a key with very many rows only where both sides of the join are dealt for it. Rows are never broadcast: by their
    size on disk Spark would take very many copies for few rows, and the driver would run out of memory.
    """
    text = dict(rows.dtypes)[key] == "string"
    made = F.concat(F.lit("."), F.col(key)) if text else F.col(key).bitwiseXOR(F.lit(0x5DEECE66D))
    made = made.alias("_made")
    return rows.select("*", made).hint("merge").join(led.select("*", made).drop(key), "_made", how).drop("_made")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames; the caller knows that nothing reads them any more."""
    for df in frames:
        files = [_plain(f) for f in df.inputFiles()]
        for path in [p for p in _register.paths if any(f.startswith(_plain(p)) for f in files)]:
            _delete(df.sparkSession, path)
            _register.paths.remove(path)


def written() -> set[str]:
    """The scratch paths that this thread has in use."""
    return set(_register.paths)


def drop_paths(spark: SparkSession, paths: set[str], unless: DataFrame) -> None:
    """Delete scratch paths but those that a DataFrame reads, and let go of shuffle files that nothing needs."""
    files = [_plain(f) for f in unless.inputFiles()]
    for path in [p for p in _register.paths if p in paths]:
        if not any(f.startswith(_plain(path)) for f in files):
            _delete(spark, path)
            _register.paths.remove(path)
    release_shuffles(spark)


def delete_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this thread; results that still read one must have been written."""
    for path in list(_register.paths):
        _delete(spark, path)
        _register.paths.remove(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _plain(path: str) -> str:
    """Paths come as file:/x and file:///x."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else path


def widened(df: DataFrame, **types: str) -> StructType:
    """df's schema and further fields; the schema that df keeps stays as it is."""
    found = StructType(list(df.schema.fields))
    for name, kind in types.items():
        found = found.add(name, kind)
    return found


def map_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names; run gives its columns in the schema's order."""
    names = df.columns
    places = StructType([StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def placed(batches: Batches) -> Batches:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, places.names)

    found = df.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(placed, places)
    return found.toDF(*schema.names)


def quoted(df: DataFrame) -> list[str]:
    """df's column names as select() reads them, whatever characters they have."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def id_crc32(column: str = "doc_id"):
    """crc32 of an integer id written as text, the rule by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
