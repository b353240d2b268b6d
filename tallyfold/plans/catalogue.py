"""Named queries over the driver's tables, one or more for every operator, with the same in ANSI SQL.

Entries are either DataFrame code with its SQL, or SQL text alone, which then goes through the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.engine import Engine
from tallyfold.functions import from_epoch, plus_seconds, safe_div, safe_mod, seconds_between, to_epoch, truncated
from tallyfold.operators import (
    beside,
    compared_with,
    cross,
    equal_pairs,
    inner,
    money_sum,
    ordered,
    projection,
    reversed_columns,
    summary,
    theta,
)
from tallyfold.sources.writer import shared_folder, write_result


class Tables:
    """The Parquet tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    """A query: SQL for any engine, and DataFrame code if it isn't run from that SQL."""

    sql: str
    build: Callable[[Tables], DataFrame] | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        if self.build is not None:
            return self.build(Tables(spark, folder))
        return Engine(spark, folder).sql(self.sql)


ENTRIES: dict[str, Entry] = {}


def _sql(name: str, sql: str) -> None:
    ENTRIES[name] = Entry(sql)


def _frame(name: str, sql: str, build: Callable[[Tables], DataFrame]) -> None:
    ENTRIES[name] = Entry(sql, build)


# Joins, scans and projections

_frame(
    "join_filter_project",
    "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 7000",
    lambda t: inner(t.orders, t.customer, "o_custkey = c_custkey").where("c_acctbal > 7000").select("o_orderkey", "c_name"),
)
_sql("comma_join", "SELECT o_totalprice FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal < 0")
_frame("scan_all", "SELECT * FROM supplier", lambda t: t.supplier)
_sql("scan_count", "SELECT COUNT(*) AS n FROM lineitem")
_frame(
    "nested_rename",
    "SELECT d, c, b, a FROM (SELECT p_partkey AS a, p_name AS b, p_size AS c, p_retailprice AS d FROM part) AS x",
    lambda t: reversed_columns(projection(t.part, a="p_partkey", b="p_name", c="p_size", d="p_retailprice")),
)
_frame(
    "const_project",
    "SELECT s_suppkey, 1 AS one, 2.5e0 AS half, 'text' AS word, TIMESTAMP '2001-02-03 04:05:06' AS moment FROM supplier",
    lambda t: projection(
        t.supplier, s_suppkey="s_suppkey", one=F.lit(1), half=F.lit(2.5), word=F.lit("text"),
        moment="timestamp_ntz'2001-02-03 04:05:06'",
    ),
)
_sql("predicate_project", "SELECT c_custkey, c_acctbal > 0 AS positive FROM customer")

# Arithmetic

_frame(
    "arith_basic",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_discount AS minus, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS nested, 10 - l_linenumber AS left_constant FROM lineitem",
    lambda t: projection(
        t.lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber", plus="l_quantity + l_tax",
        minus="l_quantity - l_discount", nested="l_extendedprice * (1 - l_discount) * (1 + l_tax)",
        left_constant="10 - l_linenumber",
    ),
)
_sql("arith_int_div", "SELECT o_orderkey, o_orderkey / CAST(4 AS DOUBLE) AS quarter FROM orders")
_frame(
    "div_zero",
    "SELECT l_orderkey, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END, 4) AS ratio FROM lineitem",
    lambda t: projection(
        t.lineitem, l_orderkey="l_orderkey", ratio=F.round(safe_div(F.col("l_extendedprice"), F.col("l_discount")), 4)
    ),
)
_frame(
    "mod_zero",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey % (l_linenumber - 1) END AS rest "
    "FROM lineitem",
    lambda t: projection(
        t.lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber",
        rest=safe_mod(F.col("l_orderkey"), F.col("l_linenumber") - 1),
    ),
)
_frame(
    "div_null",
    "SELECT o_orderkey, round(CASE WHEN nullif(o_custkey, 7) - 3 = 0 THEN 0 ELSE o_totalprice / (nullif(o_custkey, 7) - 3) END, 6) "
    "AS ratio FROM orders",
    lambda t: projection(
        t.orders, o_orderkey="o_orderkey",
        ratio=F.round(safe_div(F.col("o_totalprice"), F.nullif(F.col("o_custkey"), F.lit(7)) - 3), 6),
    ),
)
_sql(
    "datetime_compare_arith",
    "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL '30' DAY < TIMESTAMP '1996-01-01 00:00:00'",
)

# Casts

_frame(
    "cast_trunc",
    "SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS whole FROM customer",
    lambda t: projection(t.customer, c_custkey="c_custkey", whole=truncated(F.col("c_acctbal"))),
)
_sql("cast_widen", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")
_frame(
    "ts_to_epoch",
    "SELECT o_orderkey, datediff('second', TIMESTAMP '1970-01-01 00:00:00', o_orderdate) AS seconds, "
    "CAST(datediff('second', TIMESTAMP '1970-01-01 00:00:00', o_orderdate) AS DOUBLE) AS exact FROM orders",
    lambda t: projection(
        t.orders, o_orderkey="o_orderkey", seconds=to_epoch(F.col("o_orderdate")),
        exact=to_epoch(F.col("o_orderdate")).cast("double"),
    ),
)
_frame(
    "epoch_to_ts",
    "SELECT o_orderkey, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(o_orderkey * 86400) AS of_int, "
    "TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(trunc(o_totalprice) AS BIGINT)) AS of_float FROM orders",
    lambda t: projection(
        t.orders, o_orderkey="o_orderkey", of_int=from_epoch(F.col("o_orderkey") * 86400),
        of_float=from_epoch(F.col("o_totalprice")),
    ),
)

# Predicates

for _name, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}.items():
    _sql(
        f"pred_{_name}",
        f"SELECT o_orderkey FROM orders WHERE (o_orderpriority {_op} '3-MEDIUM' AND o_totalprice {_op} 150000) "
        f"OR (o_orderdate {_op} TIMESTAMP '1998-01-01 00:00:00' AND 500 {_op} o_custkey)",
    )
_sql("pred_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < l_partkey AND l_suppkey >= l_linenumber")
_frame(
    "pred_arith",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 3000",
    lambda t: t.lineitem.where(F.col("l_extendedprice") * F.col("l_discount") > 3000).select("l_orderkey", "l_linenumber"),
)
_frame(
    "pred_and4",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 50000 AND o_totalprice < 250000 "
    "AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_custkey <= 1000 ORDER BY o_orderdate, o_orderkey",
    lambda t: ordered(
        t.orders.where(
            "o_totalprice > 50000 and o_totalprice < 250000 "
            "and o_orderdate >= timestamp_ntz'1996-01-01 00:00:00' and o_custkey <= 1000"
        ).select("o_orderkey", "o_orderdate"),
        "o_orderdate",
        "o_orderkey",
    ),
)
_sql(
    "pred_and_or",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderdate > TIMESTAMP '2000-01-01 00:00:00' AND o_custkey > 700) "
    "OR o_totalprice < 10000 ORDER BY o_totalprice DESC, o_orderkey",
)
_sql("pred_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 1000 OR c_mktsegment = 'BUILDING')")
_sql(
    "pred_or3",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND "
    "(c_mktsegment = 'BUILDING' OR c_nationkey = 3 OR c_custkey < 40)",
)
_sql(
    "pred_between_in",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size IN (10, 12, 15, 20)",
)
_sql("null_filter", "SELECT o_orderkey FROM orders WHERE nullif(o_custkey, 5) < 10")
_sql("null_not_equal", "SELECT o_orderkey FROM orders WHERE nullif(o_custkey, 5) <> 10 AND o_custkey < 20")

# Joins

_frame(
    "null_join",
    "SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, nullif(o_custkey, 5) AS k FROM orders) AS o "
    "JOIN (SELECT c_custkey, nullif(c_custkey, 5) AS j FROM customer) AS c ON k = j",
    lambda t: inner(
        projection(t.orders, o_orderkey="o_orderkey", k="nullif(o_custkey, 5)"),
        projection(t.customer, c_custkey="c_custkey", j="nullif(c_custkey, 5)"),
        "k = j",
    ).select("o_orderkey", "c_custkey"),
)
for _name, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "ne": "<>"}.items():
    _frame(
        f"theta_{_name}",
        f"SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey {_op} n_nationkey",
        lambda t, op=_op: theta(t.supplier, t.nation, "s_nationkey", op, "n_nationkey").select("s_suppkey", "n_name"),
    )
_frame(
    "join_multi_key",
    "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate",
    lambda t: inner(t.orders, t.lineitem, "o_orderkey = l_orderkey", "o_orderdate < l_shipdate").select("o_orderkey", "l_linenumber"),
)
_frame(
    "join_string_key",
    "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part AS a JOIN part AS b ON a.p_name = b.p_name AND a.p_brand = b.p_brand",
    lambda t: equal_pairs(t.part, "p_partkey", "p_name", "p_brand"),
)
_sql("join_cast_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_suppkey")
_sql("join_datetime_key", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderdate = l_shipdate AND o_orderkey = l_orderkey")
_frame(
    "join_float_key",
    "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier AS a JOIN supplier AS b ON a.s_acctbal = b.s_acctbal",
    lambda t: inner(
        projection(t.supplier, a_key="s_suppkey", x="s_acctbal"), projection(t.supplier, b_key="s_suppkey", y="s_acctbal"), "x = y"
    ).select("a_key", "b_key"),
)
_sql("join_or", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey OR n_nationkey = 3")
_frame("cross_product", "SELECT s_suppkey, n_nationkey FROM supplier, nation", lambda t: cross(t.supplier.select("s_suppkey"), t.nation.select("n_nationkey")))
_frame(
    "join_3way",
    "SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey "
    "AND o_totalprice > 200000 AND c_acctbal > 0 ORDER BY o_orderkey",
    lambda t: ordered(
        inner(
            inner(t.orders.where("o_totalprice > 200000"), t.customer.where("c_acctbal > 0"), "o_custkey = c_custkey"),
            t.nation,
            "c_nationkey = n_nationkey",
        ).select("o_orderkey", "c_name", "n_name"),
        "o_orderkey",
    ),
)
_sql(
    "join_4way",
    "SELECT l_orderkey, l_linenumber, c_name, s_name FROM lineitem INNER JOIN orders ON l_orderkey = o_orderkey "
    "INNER JOIN customer ON o_custkey = c_custkey INNER JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 0 AND l_quantity < 10",
)

# Aggregates

_frame(
    "agg_all",
    "SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(c_name) AS named, COUNT(*) AS n, "
    "MIN(o_orderdate) AS first_date, MAX(o_orderdate) AS last_date, MIN(o_custkey) AS lo_key, MAX(o_custkey) AS hi_key "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 500",
    lambda t: summary(
        inner(t.orders, t.customer, "o_custkey = c_custkey").where("c_acctbal > 500"),
        lo="min(o_totalprice)", hi="max(o_totalprice)", named="count(c_name)", n="count(*)",
        first_date="min(o_orderdate)", last_date="max(o_orderdate)", lo_key="min(o_custkey)", hi_key="max(o_custkey)",
    ),
)
_sql("agg_sum_int", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem")
_frame(
    "agg_sum_float",
    "SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders",
    lambda t: summary(t.orders, total=money_sum(F.col("o_totalprice"))),
)
_sql("agg_avg", "SELECT round(AVG(o_totalprice), 4) AS mean FROM orders")
_frame(
    "agg_expr",
    "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue "
    "FROM lineitem WHERE l_quantity < 25 AND l_discount >= 0.05",
    lambda t: summary(
        t.lineitem.where("l_quantity < 25 and l_discount >= 0.05"),
        revenue="cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))) as double)",
    ),
)
_sql(
    "agg_post_expr",
    "SELECT round(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 4) AS mean FROM orders",
)
_sql("agg_neg_max", "SELECT MAX(c_acctbal) AS hi FROM customer WHERE c_acctbal < 0")
_sql("agg_empty", "SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, COUNT(c_acctbal) AS n, COUNT(*) AS rows_ FROM customer WHERE c_custkey < 0")
_sql("agg_nulls", "SELECT COUNT(nullif(o_custkey, 5)) AS keyed, COUNT(*) AS n FROM orders")

# Orders

for _name, _table, _key, _tie in (
    ("int", "part", "p_size", "p_partkey"),
    ("float", "customer", "c_acctbal", "c_custkey"),
    ("ts", "orders", "o_orderdate", "o_orderkey"),
    ("str", "customer", "c_mktsegment", "c_custkey"),
):
    for _way in ("asc", "desc"):
        _frame(
            f"order_{_name}_{_way}",
            f"SELECT {_tie}, {_key} FROM {_table} ORDER BY {_key} {_way} NULLS LAST, {_tie}",
            lambda t, table=_table, key=_key, tie=_tie, way=_way: ordered(
                getattr(t, table).select(tie, key), "-" * (way == "desc") + key, tie
            ),
        )
_sql(
    "order_alias",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag = 'R' "
    "ORDER BY net DESC, l_orderkey, l_linenumber",
)
_frame(
    "order_multi",
    "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    lambda t: ordered(t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_orderpriority", "-o_totalprice", "o_orderkey"),
)
_frame(
    "order_nulls_last",
    "SELECT o_orderkey, nullif(o_custkey, 5) AS k FROM orders ORDER BY k DESC NULLS LAST, o_orderkey",
    lambda t: ordered(projection(t.orders, o_orderkey="o_orderkey", k="nullif(o_custkey, 5)"), "-k", "o_orderkey"),
)

# Subqueries

_sql(
    "subq_min",
    "SELECT p_name, l_extendedprice FROM lineitem, part WHERE l_partkey = p_partkey AND l_extendedprice > "
    "(SELECT MIN(p_retailprice) * 30 FROM part) ORDER BY l_extendedprice DESC",
)
_frame(
    "subq_avg",
    "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND "
    "c_acctbal > (SELECT AVG(c_acctbal) FROM customer) ORDER BY c_name, o_orderkey",
    lambda t: ordered(
        compared_with(inner(t.orders, t.customer, "o_custkey = c_custkey"), "c_acctbal > scalar", t.customer, F.avg("c_acctbal"))
        .select("o_orderkey", "c_name"),
        "c_name",
        "o_orderkey",
    ),
)
_sql(
    "subq_3way",
    "SELECT o_orderkey, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey "
    "AND o_totalprice > 20000 AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' "
    "AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer) ORDER BY c_custkey, o_orderkey",
)
_frame(
    "subq_beside",
    "SELECT s_suppkey, s_acctbal - (SELECT MIN(s_acctbal) FROM supplier) AS above FROM supplier",
    lambda t: projection(
        beside(t.supplier, t.supplier, F.min("s_acctbal"), "lo"), s_suppkey="s_suppkey", above="s_acctbal - lo"
    ),
)
_sql(
    "subq_correlated",
    "SELECT c_custkey, (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey) AS spent "
    "FROM customer ORDER BY spent DESC NULLS LAST, c_custkey",
)

# Groups, sets and limits

_sql("group_having", "SELECT c_mktsegment, COUNT(*) AS n, round(AVG(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 10")
_sql(
    "group_two_keys",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, MAX(l_shipdate) AS latest, "
    "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_sql("group_nulls", "SELECT nullif(o_custkey % 5, 0) AS k, COUNT(*) AS n FROM orders GROUP BY nullif(o_custkey % 5, 0)")
_sql("group_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_sql("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
_sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey AS k FROM supplier")
_sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier")

# Joins that keep or test rows

for _name, _join in {"left": "LEFT", "right": "RIGHT", "full": "FULL"}.items():
    _sql(
        f"join_{_name}",
        f"SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 8000) AS c {_join} JOIN "
        "(SELECT * FROM supplier WHERE s_acctbal > 2000) AS s ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal",
    )
_sql("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
_sql("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
_sql(
    "exists_row",
    "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
)
_sql("not_exists_row", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount = 0)")
_sql("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")

# Further predicates, conditions and casts

_sql("pred_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%11' AND p_brand LIKE 'B%'")
_sql("pred_is_null", "SELECT o_orderkey, nullif(o_custkey, 5) IS NOT NULL AS keyed FROM orders WHERE nullif(o_custkey, 5) IS NULL OR o_custkey < 9")
_sql("pred_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_custkey, 5) IS DISTINCT FROM nullif(o_custkey, 7)")
_sql(
    "case_when",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, "
    "coalesce(nullif(c_nationkey, 3), -1) AS nation FROM customer",
)
_sql(
    "cast_text",
    "SELECT p_partkey, CAST(p_size AS STRING) AS size, CAST(CAST(p_partkey AS STRING) AS BIGINT) + 1 AS next, "
    "CAST('12.5' AS DOUBLE) AS half, upper(p_brand) AS brand, length(p_name) AS n FROM part",
)
_frame(
    "datetime_plus_seconds",
    "SELECT o_orderkey, o_orderdate + to_seconds(o_custkey) AS later, o_orderdate - to_seconds(o_custkey) AS earlier FROM orders",
    lambda t: projection(
        t.orders, o_orderkey="o_orderkey", later=plus_seconds(F.col("o_orderdate"), F.col("o_custkey")),
        earlier=plus_seconds(F.col("o_orderdate"), -F.col("o_custkey")),
    ),
)
_frame(
    "datetime_minus_datetime",
    "SELECT l_orderkey, l_linenumber, datediff('second', o_orderdate, l_shipdate) AS waited FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    lambda t: projection(
        inner(t.lineitem, t.orders, "l_orderkey = o_orderkey"), l_orderkey="l_orderkey", l_linenumber="l_linenumber",
        waited=seconds_between(F.col("o_orderdate"), F.col("l_shipdate")),
    ),
)

# Named subqueries and windows

_sql(
    "cte_twice",
    "WITH spent AS (SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) "
    "SELECT c_name, n, top FROM spent JOIN customer ON c_custkey = k WHERE n > (SELECT AVG(n) FROM spent)",
)
_sql(
    "window_rank",
    "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS place, "
    "CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS nr FROM customer "
    "ORDER BY c_custkey",
)
_sql(
    "window_running",
    "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS so_far FROM orders ORDER BY o_orderkey",
)
_sql(
    "window_lag",
    "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, "
    "COUNT(*) OVER (PARTITION BY o_custkey) AS of_customer FROM orders ORDER BY o_orderkey",
)

# Star-schema shapes

_sql(
    "star_count",
    "SELECT COUNT(*) AS n FROM lineitem, orders, customer, part WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey "
    "AND l_partkey = p_partkey AND l_quantity > 20 AND p_size < 25",
)
_sql(
    "star_4way",
    "SELECT l_orderkey, l_extendedprice FROM lineitem, orders, customer, part, supplier WHERE l_orderkey = o_orderkey "
    "AND o_custkey = c_custkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND c_mktsegment = 'BUILDING' "
    "AND o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND l_tax > 0.02",
)
_sql(
    "star_sorted",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_quantity > 30 "
    "AND o_totalprice > 100000 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber",
)
_sql(
    "star_sum",
    "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem, orders "
    "WHERE l_orderkey = o_orderkey AND l_discount > 0.03 AND o_totalprice < 200000",
)
_sql(
    "star_arith",
    "SELECT l_orderkey, l_extendedprice * l_discount AS saved, l_extendedprice - l_extendedprice * l_discount AS net, "
    "l_quantity * 2 AS twice, l_tax + l_discount AS rates FROM lineitem WHERE l_returnflag = 'A' "
    "AND l_extendedprice * (1 - l_discount) > 20000 ORDER BY net DESC, l_orderkey",
)

# Long text

_sql("long_string", "SELECT doc_id, text FROM documents WHERE text > 'M'")


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """supplier, written by the result writer under a tagged header to the session's shared folder and read as a table."""
    import uuid

    place = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    tagged = supplier.toDF("s_suppkey (N) (P)", "s_name (T)", "s_nationkey (N)", "s_acctbal (N)")
    write_result(tagged, f"{place}/supplier.csv")
    return Engine(spark, place).sql("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


ROUNDTRIP_SQL = (
    "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, s_acctbal FROM supplier"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in ENTRIES.items()} | {"csv_roundtrip": csv_roundtrip}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items()} | {"csv_roundtrip": ROUNDTRIP_SQL}
