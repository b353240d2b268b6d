import math
from collections import Counter

import pytest

import __spark_entry__
from tallyfold.plans import catalogue

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    expected = [tuple(map(plain, r)) for r in found.fetchall()]
    assert Counter(rows) == Counter(expected)
    if "ORDER BY" in catalogue.oracle_sql()[name] and len(set(expected)) == len(expected) and name not in ("subq_min", "subq_3way"):
        assert rows == expected


def test_entry_and_names(spark, sf_dir):
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "c_name"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_joins_are_hash_or_merge_joins(spark, sf_dir):
    plan = catalogue.queries()["star_count"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,20.0)" in plan
