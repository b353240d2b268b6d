"""A folder as a database: every CSV or Parquet table in it becomes a temporary view."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyfold.errors import CatalogError
from tallyfold.sources.header import Column, parse_header, schema_of, sniff
from tallyfold.types import DATETIME_FORMAT

#: Rows from which a CSV table's numeric columns are told apart.
SNIFF_ROWS = 1000

_DIALECT = {"quote": '"', "escape": '"'}


@dataclass(frozen=True)
class Table:
    """A table of a folder; columns is empty for Parquet, which brings its own schema."""

    name: str
    path: str
    columns: tuple[Column, ...] = ()

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.key)


def foreign_keys(tables: Mapping[str, Table]) -> dict[str, dict[str, tuple[str, ...]]]:
    """For each table the tables it refers to, and the columns that do.

    A column named <table>_<key column> refers to that table; of a composite key every part must be there.
    A table with no primary key is never referred to, and none refers to itself. Names are compared
    without case.
    """
    found: dict[str, dict[str, tuple[str, ...]]] = {}
    for table in tables.values():
        own = {c.name.lower(): c.name for c in table.columns}
        found[table.name] = {}
        for other in tables.values():
            parts = [own.get(f"{other.name}_{part}".lower()) for part in other.primary_key]
            if other.name != table.name and parts and all(parts):
                found[table.name][other.name] = tuple(p for p in parts if p)
    return found


def read_csv(spark: SparkSession, path: str, columns: Sequence[Column], multi_line: bool = False) -> DataFrame:
    """A CSV table with a known header, whose cells have line ends only with multi_line. Empty cells are null; a value that isn't of its type is an error."""
    reader = spark.read.schema(schema_of(columns)).option("header", True).option("enforceSchema", True)
    return reader.options(**_DIALECT, multiLine=multi_line, mode="FAILFAST", timestampNTZFormat=DATETIME_FORMAT).csv(path)


def read_columns(spark: SparkSession, path: str, sniff_rows: int = SNIFF_ROWS, multi_line: bool = False) -> list[Column]:
    """The columns of a CSV table, from its header line and first rows; only these are read."""
    first = spark.read.text(path).head(1)
    columns = parse_header(first[0][0] if first else "")
    plain = StructType()
    for i in range(len(columns)):
        plain = plain.add(f"_{i}", "string")
    rows = spark.read.schema(plain).options(**_DIALECT, multiLine=multi_line, header=True, enforceSchema=True).csv(path)
    return sniff(columns, rows.head(sniff_rows))


def list_tables(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """Name, path and whether it is CSV, of every table in a folder of any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise CatalogError(f"there is no folder {folder}")
    if not system.getFileStatus(where).isDirectory():
        raise CatalogError(f"{folder} is not a folder")
    found = []
    for status in system.listStatus(where):
        name = status.getPath().getName()
        stem, dot, suffix = name.rpartition(".")
        if not dot or not stem:
            continue
        if suffix.lower() == "csv" and status.isFile() or suffix.lower() == "parquet":
            found.append((stem, status.getPath().toString(), suffix.lower() == "csv"))
    return sorted(found)


def _named(name: str, statement: str) -> bool:
    """Whether a name occurs in a statement; one of other than word characters wherever it stands."""
    return name in (re.findall(r"\w+", statement) if re.fullmatch(r"\w+", name) else statement)


class Catalog:
    """The tables of one folder, as temporary views of a session.

    Files are listed at each refresh, but only the tables that are asked for are opened.
    """

    def __init__(self, spark: SparkSession, folder: str, multi_line: bool = False):
        self.spark, self.folder, self.multi_line = spark, folder, multi_line
        self.found = {name: (path, is_csv) for name, path, is_csv in list_tables(spark, folder)}
        self.tables: dict[str, Table] = {}

    def refresh(self, statement: str | None = None) -> None:
        """Read the folder anew: views of tables that are gone go, and changed headers hold from now on.

        Of the tables, those are opened whose names occur in a statement; without one, all.
        """
        self.found = {name: (path, is_csv) for name, path, is_csv in list_tables(self.spark, self.folder)}
        for name in self.tables.keys() - self.found.keys():
            self.drop(name)
        for name, (path, is_csv) in self.found.items():
            if statement is None or _named(name.lower(), statement.lower()):
                self._open(name, path, is_csv)
            elif name in self.tables:
                self.drop(name)

    def _open(self, name: str, path: str, is_csv: bool) -> None:
        if is_csv:
            table = Table(name, path, tuple(read_columns(self.spark, path, multi_line=self.multi_line)))
            frame = read_csv(self.spark, path, table.columns, self.multi_line)
        else:
            table, frame = Table(name, path), self.spark.read.parquet(path)
        frame.createOrReplaceTempView(f"`{name}`")
        self.tables[name] = table

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.tables.pop(name, None)

    def table(self, name: str) -> DataFrame:
        found = {n.lower(): n for n in self.tables}.get(name.lower())
        if found is None:
            raise CatalogError(f"there is no table {name}")
        return self.spark.table(f"`{found}`")

    def describe(self, name: str) -> DataFrame:
        """column_name, column_type, key and refers_to of a table's columns; all tables must be open."""
        frame = self.table(name)
        table = next(t for n, t in self.tables.items() if n.lower() == name.lower())
        refers = {c: other for other, columns in foreign_keys(self.tables)[table.name].items() for c in columns}
        rows = [
            (f.name, f.dataType.simpleString(), f.name in table.primary_key, refers.get(f.name))
            for f in frame.schema.fields
        ]
        return self.spark.createDataFrame(rows, "column_name string, column_type string, key boolean, refers_to string")
