"""A folder to which CSV files of one tagged header keep being added, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.catalog import read_columns
from tallyfold.sources.header import schema_of
from tallyfold.types import DATETIME_FORMAT


def read_csv_stream(spark: SparkSession, folder: str, sample: str, files_a_trigger: int = 100) -> DataFrame:
    """Rows of the files in folder, now and later; sample is a file that has the header they share."""
    schema = schema_of(read_columns(spark, sample))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    options = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "timestampNTZFormat": DATETIME_FORMAT}
    return reader.options(**options).csv(folder)
