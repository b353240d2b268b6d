"""The engine: one current folder, SQL over it, and results in files."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from pathlib import Path
from statistics import mean, median, pstdev

from pyspark.sql import DataFrame, SparkSession

from tallyfold.errors import CatalogError, StatementError
from tallyfold.sources.catalog import Catalog
from tallyfold.sources.writer import target, write_parts, write_result

_FIRST_WORD = re.compile(r"[A-Za-z]+")


@dataclass(frozen=True)
class Timing:
    """Milliseconds of some runs of a statement; std is that of a whole population."""

    mean: float
    median: float
    min: float
    max: float
    std: float

    @classmethod
    def of(cls, runs: list[float]) -> Timing:
        return cls(mean(runs), median(runs), min(runs), max(runs), pstdev(runs))

    def __str__(self) -> str:
        return ", ".join(f"{k} {v:.1f} ms" for k, v in vars(self).items())


@dataclass(frozen=True)
class Outcome:
    """What a statement did: a message, and the file it wrote, if it wrote one."""

    message: str
    path: str | None = None


class Engine:
    """SELECT over the tables of a folder.

    The engine has a session of its own, with its own views and UTC, beside the one it is given; it keeps no
    state outside itself. Statements see the folder as it is when they start. multi_line: cells of CSV tables may
    have line ends, as text in results has; each file is then read by one task.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, results: str = "results", multi_line: bool = False):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.results, self.multi_line = results, multi_line
        self.catalog: Catalog | None = None
        if folder is not None:
            self.use(folder)

    def use(self, folder: str) -> None:
        """Make folder the current one. A folder that isn't there is an error, and the one before stays."""
        catalog = Catalog(self.spark, folder, self.multi_line)
        for name in list(self.catalog.tables) if self.catalog else ():
            self.catalog.drop(name)
        self.catalog = catalog

    def _refreshed(self, statement: str | None = None) -> Catalog:
        if self.catalog is None:
            raise CatalogError("no folder is in use")
        self.catalog.refresh(statement)
        return self.catalog

    def sql(self, query: str) -> DataFrame:
        """The result of a query, not yet computed."""
        self._refreshed(query)
        return self.spark.sql(_statement(query))

    def table(self, name: str) -> DataFrame:
        return self._refreshed(name).table(name)

    def describe(self, table: str) -> DataFrame:
        """Columns, types, keys and references of a table."""
        return self._refreshed().describe(table)

    def explain(self, query: str) -> str:
        """The plans of a query, from parsed to physical; nothing is run."""
        return self.sql(query)._jdf.queryExecution().toString()

    def execute(self, statement: str, out: str | None = None, parts: bool = False) -> Outcome:
        """Run a statement of any kind: USE, EXPLAIN, DESCRIBE, DUCKDB, or else a query.

        Results go to out, or to a file of the results folder named after the time, on the default file system or
        that of out. With parts a query's result is a folder of files with headers, which its tasks write; else
        the driver puts them together. Keywords are read without case. Errors are raised.
        """
        text = _statement(statement)
        word = _FIRST_WORD.match(text)
        kind, rest = (word[0].lower(), text[word.end() :].strip()) if word else ("", text)
        if kind == "use":
            if not rest:
                raise StatementError("USE needs a folder")
            self.use(rest.strip("'\""))
            return Outcome(f"using {rest}")
        if kind == "explain":
            path = out or self._result_path("result", "txt")
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(self.explain(rest), encoding="utf-8")
            return Outcome(f"plan written to {path}", path)
        if kind in ("describe", "desc"):
            found = self.describe(rest.strip("`\""))
            return Outcome("\n".join(" ".join(str(v) for v in row) for row in found.collect()))
        path = out or self._result_path("duck_output" if kind == "duckdb" else "our_output", "csv")
        if kind == "duckdb":
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            from tallyfold.plans.oracle import copy_result

            copy_result(self._refreshed(), rest, path)
        else:
            place = target(self.spark, path)
            if parts:
                write_parts(self.sql(text), place, header=True)
            else:
                write_result(self.sql(text), place)
        return Outcome(f"result written to {path}", path)

    def timed(self, statement: str, warm_ups: int = 2, runs: int = 5, out: str | None = None) -> tuple[Outcome, Timing]:
        """Run a statement several times; the warm-ups aren't counted."""
        took, outcome = [], Outcome("")
        for _ in range(warm_ups + runs):
            began = time.perf_counter()
            outcome = self.execute(statement, out)
            took.append((time.perf_counter() - began) * 1000)
        return outcome, Timing.of(took[warm_ups:])

    def _result_path(self, stem: str, suffix: str) -> str:
        return f"{self.results}/{stem}_{time.time_ns() // 1_000_000}.{suffix}"


def _statement(text: str) -> str:
    found = text.strip().rstrip(";").strip()
    if not found:
        raise StatementError("the statement is empty")
    return found
