"""Joins on keys that nearly all rows have are split by Spark."""

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import components, session, simhash, warc

LOW = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def test_a_star_of_very_many_nodes(low):
    pairs = low.range(200_000).repartition(8).select(
        F.when(F.col("id") % 10 < 9, F.lit(-1)).otherwise(F.col("id")).alias("node"), F.xxhash64("id").alias("other")
    )
    found = components._with_least(pairs)
    assert "skew=true" in final_plan(found) and found.count() == 200_000


def test_a_payload_of_nearly_all_pages(low, monkeypatch):
    pages = low.range(60_000).repartition(8).select(
        F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"),
        F.when(F.col("id") % 10 < 9, F.lit("same")).otherwise(F.concat(F.lit("page "), F.col("id") % 3000)).alias("html"),
    )
    latest, _ = warc.repeated_payloads(pages)
    assert "SortMergeJoin" not in final_plan(warc._records(pages, latest, None))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert "skew=true" in final_plan(warc._records(pages, latest, None))


def test_tables_are_broadcast_up_to_a_size_on_disk(spark, monkeypatch):
    table = session.materialise(spark.range(1000), "few")
    plan = lambda: spark.range(10**6).join(session.small(table), "id")._jdf.queryExecution().toString()
    assert "rightHint=(strategy=broadcast)" in plan() or "strategy=broadcast" in plan()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert "strategy=broadcast" not in plan()


def test_lists_are_broadcast_up_to_their_size_in_memory(spark):
    item = F.struct(F.lit(1).cast("long").alias("a"), F.lit("text").alias("b"), F.array(F.lit(1)).alias("c"))
    wide = spark.range(1000).withColumn("found", F.array_repeat(item, 1000)).withColumn("plain", F.array_repeat(F.lit(2), 10))
    table = session.materialise(wide, "lists")
    assert session.bytes_on_disk(table) < 1 << 20
    found = spark.range(10**6).join(session.small(table), "id")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    held = table.agg(F.sum(session.unpacked_bytes(table))).first()[0]
    assert 1000 * 1000 * 56 <= held <= 1000 * 1000 * 100
    few = session.materialise(table.limit(3), "lists")
    assert "strategy=broadcast" in spark.range(10**6).join(session.small(few), "id")._jdf.queryExecution().toString()
    nulls = session.materialise(spark.createDataFrame([(1, None, None)], "id long, t string, l array<struct<x: string>>"), "nulls")
    assert nulls.agg(F.sum(session.unpacked_bytes(nulls))).first()[0] > 0


def test_very_many_copies_are_not_broadcast(spark):
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a text that all rows have").alias("text"))
    found = simhash.near_duplicates(rows)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("component_id").count().collect() == [(0, 300_000)]


def test_balls_about_fingerprints_are_not_broadcast(spark):
    prints = session.materialise(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "prints")
    assert "BroadcastHashJoin" not in final_plan(simhash.links(prints))
    one = F.lit(0).alias("segment"), F.lit(1).cast("long").alias("word"), "fp"
    hot = simhash._hot_links(prints.select(*one), prints.select(*one, F.lit(0).alias("off")), simhash.RADIUS)
    assert "BroadcastHashJoin" not in hot._jdf.queryExecution().executedPlan().toString()
