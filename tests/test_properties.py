import csv
import datetime as dt
import shutil
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyfold import Engine
from tallyfold.streaming import read_csv_stream

words = st.text(st.characters(codec="utf-8", exclude_categories=("Cc", "Cs", "Zl", "Zp")), min_size=1, max_size=12).filter(
    lambda s: s == s.strip() and s
)
moments = st.datetimes(dt.datetime(1000, 1, 1), dt.datetime(2999, 1, 1)).map(lambda t: t.replace(microsecond=0))
floats = st.floats(-1e9, 1e9).map(lambda x: round(x, 3))
maybe = lambda s: st.one_of(s, s, s, st.none())
rows = st.lists(st.tuples(maybe(st.integers(-(2**31), 2**31 - 1)), maybe(floats), maybe(moments), maybe(words)), max_size=8)


@given(rows)
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_a_tagged_file_comes_back(spark, tmp_path, values):
    folder = Path(tmp_path) / "db"
    shutil.rmtree(folder, ignore_errors=True)
    folder.mkdir()
    with (folder / "t.csv").open("w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        out.writerow(["id (N) (P) ", "i (N) ", "f (N) ", "d (D) ", "s (T) "])
        out.writerow([0, "", "0.5", "", ""])
        for n, row in enumerate(values):
            out.writerow([n + 1, *("" if v is None else v for v in row)])
    found = [tuple(r) for r in Engine(spark, str(folder)).sql("SELECT i, f, d, s FROM t ORDER BY id").collect()]
    assert found == [(None, 0.5, None, None), *values]


def test_files_that_are_added_are_streamed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"id (N) (P),x (N)\n{i},{i}.5\n")
    stream = read_csv_stream(spark, str(folder), str(folder / "0.csv"), files_a_trigger=1).where("x > 1")
    query = stream.writeStream.format("memory").queryName("added").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("added").collect()) == [(1, 1.5), (2, 2.5)]
