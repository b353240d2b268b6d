"""The same folder in DuckDB, where that is installed: for comparing results, apart from the engine."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from tallyfold.errors import StatementError
from tallyfold.sources.catalog import Catalog
from tallyfold.types import Kind

_TYPES = {Kind.INT: "INTEGER", Kind.FLOAT: "DOUBLE", Kind.DATETIME: "TIMESTAMP", Kind.STRING: "VARCHAR"}


def copy_result(catalog: Catalog, query: str, path: str) -> None:
    """Run a query in DuckDB over the catalogue's tables and write its result as CSV. Local folders only."""
    try:
        import duckdb
    except ImportError as error:
        raise StatementError("DuckDB isn't installed") from error
    with duckdb.connect() as connection:
        for table in catalog.tables.values():
            source = unquote(urlsplit(table.path).path).replace("'", "''")
            if table.columns:
                types = ", ".join(
                    f"'{c.name}': '{'BIGINT' if c.wide else _TYPES[c.kind]}'".replace('"', "") for c in table.columns
                )
                reader = f"read_csv('{source}', header = false, skip = 1, quote = '\"', escape = '\"', columns = {{{types}}})"
            else:
                reader = f"read_parquet('{source}')"
            connection.execute(f'CREATE VIEW "{table.name}" AS SELECT * FROM {reader}')
        target = path.replace("'", "''")
        connection.execute(f"COPY ({query.strip().rstrip(';')}) TO '{target}' (FORMAT csv, HEADER)")
