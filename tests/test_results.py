import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold import Engine
from tallyfold.batch import run
from tallyfold.cli import Shell
from tallyfold.errors import StatementError
from tallyfold.sources.writer import write_parts, write_result


def written(df, path):
    write_result(df, path.as_uri())
    return path.read_text()


def test_format(spark, tmp_path):
    rows = [(1, 2.5, dt.datetime(1969, 12, 31, 23, 59, 59), 'a "b", c', True, 7), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, f double, d timestamp_ntz, s string, b boolean, l long").coalesce(1)
    df = df.withColumn("m", F.lit(1).cast("decimal(9,1)"))
    assert written(df, tmp_path / "r.csv") == (
        'i,f,d,s,b,l,m\n1,2.5000,"1969-12-31 23:59:59","a ""b"", c","true",7,1.0000\n"","","","","","",1.0000\n'
    )


def test_odd_numbers_and_names(spark, tmp_path):
    df = spark.sql("SELECT double('NaN') AS `a.b`, double('Infinity') AS a, 1e30D AS `q``q`, -0.00004D AS a")
    assert written(df, tmp_path / "r.csv").splitlines() == ["a.b,a,q`q,a", f"NaN,Infinity,1{"0" * 30}.0000,-0.0000"]


def test_an_empty_result_has_its_header(spark, tmp_path):
    assert written(spark.range(0), tmp_path / "r.csv") == "id\n"


def test_order_across_partitions_and_replacement(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("old")
    df = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    assert written(df, path).split() == ["id", *map(str, range(999, -1, -1))]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.csv"]


def test_parts(spark, tmp_path):
    write_parts(spark.range(10).repartition(3), (tmp_path / "parts").as_uri())
    lines = [line for p in (tmp_path / "parts").glob("part-*") for line in p.read_text().split()]
    assert sorted(map(int, lines)) == list(range(10))


def test_statements(spark, shop, tmp_path):
    engine = Engine(spark, results=str(tmp_path / "out"))
    assert engine.execute(f"  uSe {shop} ;").path is None
    done = engine.execute("select Name from Employee where Salary >= 200 order by Salary;")
    assert done.path.startswith(str(tmp_path / "out" / "our_output_"))
    with open(done.path) as f:
        assert f.read() == 'Name\n"Bob"\n"Cyd"\n'
    plan = engine.execute("EXPLAIN SELECT Name FROM Employee")
    with open(plan.path) as f:
        assert plan.path.endswith(".txt") and "Physical Plan" in f.read()
    assert "JoinedDate timestamp_ntz" in engine.execute("DESCRIBE employee").message
    for bad in ("", "  ; ", "USE ;"):
        with pytest.raises(StatementError):
            engine.execute(bad)


def test_the_other_engine_agrees(spark, shop, tmp_path):
    pytest.importorskip("duckdb")
    engine = Engine(spark, shop, str(tmp_path))
    done = engine.execute("duckdb SELECT Employee_id, Name FROM Employee ORDER BY Salary DESC NULLS LAST")
    with open(done.path) as f:
        assert f.read().splitlines()[:3] == ["Employee_id,Name", "3,Cyd", "2,Bob"]


def test_timing(spark, shop, tmp_path):
    engine = Engine(spark, shop, str(tmp_path))
    done, timing = engine.timed("SELECT 1 AS x", warm_ups=1, runs=2, out=str(tmp_path / "x.csv"))
    assert done.path and 0 < timing.min <= timing.median <= timing.max and timing.std >= 0


def test_batch(spark, shop, tmp_path):
    query = tmp_path / "query7.txt"
    query.write_text("SELECT COUNT(*) AS n\nFROM Orders;\n")
    path = run(spark, shop, str(query), str(tmp_path))
    assert path == str(tmp_path / "query7.csv")
    with open(path) as f:
        assert f.read() == "n\n6\n"


def test_shell(spark, shop, tmp_path):
    said = []
    shell = Shell(Engine(spark, results=str(tmp_path)), said.append, warm_ups=0, runs=1)
    assert all(map(shell.feed, ["_help", f"use {shop};", "SELECT Name", "FROM Employee", ";", "SELECT * FROM nowhere;"]))
    assert "EXPLAIN" in said[0] and "using" in said[1] and "result written" in said[2] and said[3].startswith("error")
    assert shell.complete("Emp", 0) == "Employee" and not shell.feed("_exit")


def test_parts_with_headers(spark, shop, tmp_path):
    engine = Engine(spark, shop, str(tmp_path))
    for where, least in (("Salary > 0", 1), ("Salary < 0", 0)):
        folder = tmp_path / f"parts{least}"
        engine.execute(f"SELECT Name FROM Employee WHERE {where}", str(folder), parts=True)
        files = [p.read_text().splitlines() for p in folder.iterdir() if p.name.startswith("part-") and p.stat().st_size]
        assert files and all(lines[0] == "Name" for lines in files) and sum(map(len, files)) - len(files) == 3 * least


def test_line_ends_in_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "one")], "`k (N) (P)` int, `t (T)` string")
    write_result(df, (tmp_path / "note.csv").as_uri())
    found = Engine(spark, str(tmp_path), multi_line=True).sql("SELECT k, t FROM note ORDER BY k").collect()
    assert [tuple(r) for r in found] == [(1, 'two\nlines, "quoted"'), (2, "one")]


def test_results_of_a_cluster_need_a_shared_path(spark, tmp_path, monkeypatch):
    from tallyfold.sources import writer

    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    with pytest.raises(StatementError):
        writer.target(spark, str(tmp_path / "r.csv"))
