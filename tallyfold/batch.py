"""``python -m tallyfold.batch FOLDER QUERY_FILE [OUT_FOLDER]``: run one query file over a folder."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tallyfold.engine import Engine


def run(spark: SparkSession, folder: str, query_file: str, out_folder: str = ".") -> str:
    """The result is <out_folder>/<name of the query file>.csv; its path is returned."""
    query = Path(query_file)
    target = Path(out_folder) / f"{query.stem}.csv"
    Engine(spark, folder).execute(query.read_text(encoding="utf-8"), str(target))
    return str(target)


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tallyfold").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(run(spark, *args))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
