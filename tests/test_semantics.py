"""What the engine decides where engines differ."""

import datetime as dt

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyfold import Engine
from tallyfold.functions import (
    from_epoch,
    from_epoch_sql,
    order_sql,
    safe_div,
    safe_div_sql,
    safe_mod,
    safe_mod_sql,
    to_epoch,
    to_epoch_sql,
    truncated,
    truncated_sql,
)
from tallyfold.operators import ordered, theta


@pytest.fixture(scope="module")
def ask(spark, shop):
    engine = Engine(spark, shop)
    return lambda query: [tuple(r) for r in engine.sql(query).collect()]


def test_zero_divisors_and_nulls(spark):
    df = spark.createDataFrame([(7, 2), (7, 0), (None, 0), (7, None), (-7, 2)], "a int, b int")
    found = df.select(
        safe_div(F.col("a"), F.col("b")), safe_mod(F.col("a"), F.col("b")),
        F.expr(safe_div_sql("a", "b")), F.expr(safe_mod_sql("a", "b")),
    ).collect()
    expected = [(3.5, 1), (0.0, 0), (None, None), (None, None), (-3.5, -1)]
    assert [tuple(r) for r in found] == [(*e, *e) for e in expected]


def test_plain_zero_division_and_overflow_raise(ask):
    for bad in ("SELECT Salary / 0 FROM Employee", "SELECT Employee_id + 2147483647 FROM Employee"):
        with pytest.raises((PySparkException, Py4JError)):
            ask(bad)


def test_casts(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 59), -2.9, 86400)], "t timestamp_ntz, x double, n int")
    row = df.select(
        to_epoch(F.col("t")), F.expr(to_epoch_sql("t")), truncated(F.col("x")), F.expr(truncated_sql("x")),
        from_epoch(F.col("n")), F.expr(from_epoch_sql("n")), from_epoch(F.col("x")),
    ).first()
    day = dt.datetime(1970, 1, 2)
    assert tuple(row) == (-1, -1, -2, -2, day, day, dt.datetime(1969, 12, 31, 23, 59, 58))


def test_nulls_in_predicates_joins_and_sorts(ask, spark):
    assert ask("SELECT Order_id FROM Orders WHERE Employee_id < 5 OR Employee_id >= 5") == [(i,) for i in range(1, 6)]
    assert ask("SELECT COUNT(*) FROM Orders a JOIN Orders b ON a.Employee_id = b.Employee_id") == [(9,)]
    assert ask("SELECT Order_id FROM Orders WHERE NOT (TotalAmount > 0 OR Product_id = 40)") == []
    assert ask(f"SELECT Employee_id FROM Employee ORDER BY {order_sql('Salary', True)}")[-1] == (4,)
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "i int, k int")
    assert [r["i"] for r in ordered(df, "-k", "-i").collect()] == [3, 4, 2, 1]
    assert [r["i"] for r in ordered(df, "k", "i").collect()] == [2, 4, 3, 1]


def test_aggregates_of_nothing_and_of_negatives(ask):
    assert ask("SELECT MIN(Price), MAX(Price), SUM(Price), AVG(Price), COUNT(Price), COUNT(*) FROM Product WHERE Price > 999") == [
        (None, None, None, None, 0, 0)
    ]
    assert ask("SELECT MAX(Price), COUNT(ProductName), COUNT(*) FROM Product WHERE Price < 0") == [(-3.0, 0, 1)]


def test_nested_conditions(ask):
    assert ask("SELECT Order_id FROM Orders WHERE Product_id > 0 AND (Order_id = 1 OR Order_id = 2 OR Order_id = 4)") == [(1,), (2,), (4,)]
    assert ask("SELECT Order_id FROM Orders WHERE NOT Order_id > 2") == [(1,), (2,)]


def test_long_text_is_whole(ask):
    assert ask("SELECT length(CustomerName) FROM Orders WHERE Order_id = 5") == [(300,)]


def test_a_subquery_of_several_rows_raises(ask):
    with pytest.raises((PySparkException, Py4JError)):
        ask("SELECT Name FROM Employee WHERE Salary > (SELECT Salary FROM Employee)")


@pytest.mark.parametrize(("op", "n"), [("=", 4), ("<>", 12), ("<", 6), ("<=", 10), (">", 6), (">=", 10)])
def test_theta_joins(spark, op, n):
    a, b = spark.range(4).toDF("a"), spark.range(4).toDF("b")
    assert theta(a, b, "a", op, "b").count() == n
