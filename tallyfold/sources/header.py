"""Tagged CSV headers: ``name (TAG) [(P)]`` in each cell.

N is a number, D a datetime, T text, P a part of the primary key. Pure functions; nothing here needs Spark
to run.
"""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql.types import StructField, StructType

from tallyfold.errors import HeaderError
from tallyfold.types import KEY_TAG, TAGS, Kind, spark_type

_TAG = re.compile(r"\s*\(\s*([A-Za-z])\s*\)\s*$")
_INT32 = range(-(2**31), 2**31)


@dataclass(frozen=True)
class Column:
    """A column of a table; wide: whole numbers beyond 32 bits."""

    name: str
    kind: Kind
    key: bool = False
    wide: bool = False

    def field(self) -> StructField:
        return StructField(self.name, spark_type(self.kind, self.wide), True, {"pk": True} if self.key else None)


def split_line(line: str) -> list[str]:
    """The cells of one CSV line; quotes are doubled within quoted cells."""
    return next(csv.reader([line.strip("\r\n﻿")]), [])


def parse_cell(cell: str) -> Column:
    """A column from its header cell. A cell with no type tag is text, with a warning."""
    rest, key, kind = cell.strip(), False, None
    while (found := _TAG.search(rest)) is not None:
        tag = found[1].upper()
        if tag == KEY_TAG and not key and kind is None:
            key = True
        elif tag in TAGS and kind is None:
            kind = TAGS[tag]
        else:
            break
        rest = rest[: found.start()]
    name = rest.strip()
    if not name:
        raise HeaderError(f"a column has no name: {cell!r}")
    if kind is None:
        warnings.warn(f"column {name!r} has no type tag and is taken as text", stacklevel=2)
        kind = Kind.STRING
    return Column(name, kind, key)


def parse_header(line: str) -> list[Column]:
    """The columns of a header line, numbers still as INT."""
    columns = [parse_cell(cell) for cell in split_line(line)] if line.strip() else []
    if not columns:
        raise HeaderError("a table has no columns")
    seen = {c.name.lower() for c in columns}
    if len(seen) < len(columns):
        raise HeaderError(f"a column name is used twice: {[c.name for c in columns]}")
    return columns


def sniff(columns: Sequence[Column], rows: Iterable[Sequence[str | None]]) -> list[Column]:
    """Columns with numbers told apart by sample rows: FLOAT if any has a point or an exponent, else INT.

    Whole numbers that 32 bits can't hold make the column wide. Empty cells tell nothing.
    """
    found = list(columns)
    for row in rows:
        for i, (column, cell) in enumerate(zip(found, row, strict=False)):
            text = (cell or "").strip()
            if column.kind is not Kind.INT or not text:
                continue
            if any(c in text for c in ".eE"):
                found[i] = replace(column, kind=Kind.FLOAT, wide=False)
            elif not column.wide and text.lstrip("+-").isdigit() and int(text) not in _INT32:
                found[i] = replace(column, wide=True)
    return found


def schema_of(columns: Sequence[Column]) -> StructType:
    return StructType([c.field() for c in columns])
