"""``python -m tallyfold.cli``: a shell that reads statements up to a semicolon.

_help, _clear and _exit are commands of the shell. Statements are timed: two warm-ups, then five runs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tallyfold.engine import Engine
from tallyfold.errors import TallyfoldError

KEYWORDS = (
    "SELECT FROM WHERE ORDER BY ASC DESC JOIN ON INNER LEFT RIGHT FULL CROSS AND OR NOT BETWEEN IN AS MIN MAX "
    "SUM AVG COUNT USE EXPLAIN DESCRIBE _help _clear _exit"
).split()

HELP = """USE <folder>;        take the tables of a folder
SELECT ...;          write the result to a file
EXPLAIN SELECT ...;  write the plan to a file
DESCRIBE <table>;    show columns
_help, _clear, _exit"""


class Shell:
    """Puts lines together to statements and runs them."""

    def __init__(self, engine: Engine, say: Callable[[str], None] = print, warm_ups: int = 2, runs: int = 5):
        self.engine, self.say, self.warm_ups, self.runs = engine, say, warm_ups, runs
        self.lines: list[str] = []

    @property
    def prompt(self) -> str:
        return "...> " if self.lines else "sql> "

    def feed(self, line: str) -> bool:
        """Take one line; false if the shell is to end. Errors are said, not raised."""
        command = line.strip().lower()
        if not self.lines and command in ("_exit", "_help", "_clear"):
            if command != "_exit":
                self.say(HELP if command == "_help" else "\x1b[2J\x1b[H")
            return command != "_exit"
        if line.strip():
            self.lines.append(line)
        if command.endswith(";"):
            statement, self.lines = "\n".join(self.lines), []
            self.say(self.answer(statement))
        return True

    def answer(self, statement: str) -> str:
        try:
            if statement.strip().lower().startswith("use"):
                return self.engine.execute(statement).message
            outcome, timing = self.engine.timed(statement, self.warm_ups, self.runs)
            return f"{outcome.message}\n{timing}"
        except (TallyfoldError, PySparkException, Py4JError) as error:
            return f"error: {error}"

    def complete(self, text: str, state: int) -> str | None:
        """Keywords, and names of tables and of columns of opened tables, that begin with text."""
        names = list(KEYWORDS)
        if self.engine.catalog:
            names += self.engine.catalog.found
            names += [c.name for table in self.engine.catalog.tables.values() for c in table.columns]
        found = sorted({n for n in names if n.lower().startswith(text.lower())})
        return found[state] if state < len(found) else None


def _input_lines(shell: Shell, history: Path) -> Iterable[str]:
    try:
        import readline
    except ImportError:
        readline = None
    if readline:
        readline.set_completer(shell.complete)
        readline.parse_and_bind("tab: complete")
        if history.exists():
            readline.read_history_file(history)
    try:
        while True:
            yield input(shell.prompt)
    except (EOFError, KeyboardInterrupt):
        return
    finally:
        if readline:
            readline.write_history_file(history)


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tallyfold").config("spark.ui.enabled", "false").getOrCreate()
    shell = Shell(Engine(spark, *args[:1]))
    try:
        for line in _input_lines(shell, Path.home() / ".tallyfold_history"):
            if not shell.feed(line):
                break
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
