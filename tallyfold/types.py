"""The four logical types of a tagged CSV folder and what they are in Spark."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

#: Text form of a datetime, in files and in results.
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


class Kind(Enum):
    """A column's logical type."""

    INT = "INT"
    FLOAT = "FLOAT"
    DATETIME = "DATETIME"
    STRING = "STRING"


#: Tags of a header cell other than the key tag; numbers are told apart by their values.
TAGS = {"N": Kind.INT, "D": Kind.DATETIME, "T": Kind.STRING}
KEY_TAG = "P"

_SPARK = {
    Kind.INT: T.IntegerType(),
    Kind.FLOAT: T.DoubleType(),
    Kind.DATETIME: T.TimestampNTZType(),
    Kind.STRING: T.StringType(),
}


def spark_type(kind: Kind, wide: bool = False) -> T.DataType:
    """The Spark type of a column; wide: whole numbers that 32 bits can't hold."""
    return T.LongType() if kind is Kind.INT and wide else _SPARK[kind]


def kind_of(data_type: T.DataType) -> Kind:
    """The logical type under which a result column is written."""
    if isinstance(data_type, T.IntegralType):
        return Kind.INT
    if isinstance(data_type, T.NumericType):
        return Kind.FLOAT
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Kind.DATETIME
    return Kind.STRING
