"""Results as CSV files of a fixed format.

The header is not quoted; text and datetimes are, with quotes doubled inside; whole numbers stand as they
are and other numbers with four decimals; null is an empty pair of quotes. The header is written for empty
results too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.errors import StatementError
from tallyfold.types import DATETIME_FORMAT, Kind, kind_of


def _cell(field: T.StructField) -> Column:
    value = F.col(f"`{field.name.replace('`', '``')}`")
    kind = kind_of(field.dataType)
    if kind is Kind.INT:
        text = value.cast("string")
    elif kind is Kind.FLOAT:
        text = F.format_string("%.4f", value.cast("double"))
        text = F.when(value.isNull(), None).otherwise(text)
    elif kind is Kind.DATETIME:
        text = F.concat(F.lit('"'), F.date_format(value, DATETIME_FORMAT), F.lit('"'))
    else:
        plain = value.cast("string")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            plain = F.to_json(value)
        text = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text, F.lit('""'))


def header_line(df: DataFrame) -> str:
    return ",".join(df.columns)


def format_rows(df: DataFrame) -> DataFrame:
    """One column ``value``: the line of each row, in df's order."""
    names = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    cells = [_cell(f) for f in plain.schema.fields]
    return plain.select(F.concat_ws(",", *cells).alias("value") if cells else F.lit("").alias("value"))


def target(spark: SparkSession, path: str) -> str:
    """Where a result of this path goes: what has a scheme stays, else it is a path of the default file system.

    On a cluster a path of the machine itself is an error: each executor would write to its own disk, and the
    driver would put together what it alone has.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(conf)
    if system.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        raise StatementError(f"{path} is on one machine; a cluster needs a path that all of it shares")
    return system.makeQualified(found).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that spark.checkpoint.dir names; a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise StatementError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def write_parts(df: DataFrame, folder: str, header: bool = False) -> None:
    """Lines of df under folder, one file for each partition, in the order of their names.

    With header each file that has lines begins with it; a result of no lines is one file of the header. Nothing
    goes through the driver.
    """
    if not header:
        format_rows(df).write.text(folder)
        return
    line = header_line(df)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            if batch.num_rows and not started:
                started = True
                yield pa.RecordBatch.from_arrays([pa.array([line])], schema=batch.schema)
            yield batch

    rows = format_rows(df).mapInArrow(headed, "value string")
    rows.write.text(folder)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(conf)
    if not any(s.getLen() for s in system.listStatus(where)):
        out = system.create(jvm.org.apache.hadoop.fs.Path(where, "part-header.txt"), True)
        out.write(bytearray((line + "\n").encode()))
        out.close()


def write_result(df: DataFrame, path: str) -> str:
    """Write df as one file at path, replacing it.

    Tasks format and write their partitions side by side; the driver only puts header and parts together,
    byte by byte, in the order of the partitions.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(target.getParent() or ".", f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        write_parts(df, parts.toString())
        out = system.create(target, True)
        try:
            out.write(bytearray((header_line(df) + "\n").encode()))
            names = sorted(s.getPath().getName() for s in system.listStatus(parts))
            for name in (n for n in names if n.startswith("part-")):
                part = system.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
        finally:
            out.close()
    finally:
        system.delete(parts, True)
    return path
