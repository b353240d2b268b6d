import zlib

import pytest

from tallyfold.llm import sharding
from tests.llm.conftest import rows, with_clashes


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 63, 64, 65, 997, 4099])
def test_it_is_a_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "number").selectExpr("number", f"{n}L AS total")
    moved = [r["to"] for r in sharding.permute(df, "number", "total", 7, "to").orderBy("number").collect()]
    assert sorted(moved) == list(range(n))
    if n > 60:
        assert sum(a == b for a, b in enumerate(moved)) < n / 8
        other = [r["to"] for r in sharding.permute(df, "number", "total", 8, "to").orderBy("number").collect()]
        assert other != moved


def test_laws(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sharding.shard_documents(docs).collect()
    slots = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_places_don_t_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows(sharding.shard_documents(docs)) == rows(sharding.shard_documents(docs.repartition(13, "text")))


def test_odd_rows(odd_docs, no_docs):
    found = sharding.shard_documents(odd_docs).collect()
    assert len(found) == odd_docs.count() and len({(r["shard"], r["slot"]) for r in found}) == len(found)
    assert [(r["size"], r["text_crc32"]) for r in found if r["doc_id"] == 1] == [(1, 0)]
    assert sharding.shard_documents(no_docs).collect() == []


def test_other_columns_stay(spark, odd_docs):
    df = with_clashes(odd_docs.where("doc_id is not null"), "shard", "slot", "_tf_row", "bucket")
    found = sharding.shard_rows(df.drop("_tf_row"), 3, order=["doc_id", "text"])
    assert set(found.columns) == set(df.drop("_tf_row").columns) and found.where("bucket = 'clash'").count() == 11


def test_written_shards(spark, odd_docs, tmp_path):
    placed = sharding.shard_rows(odd_docs.where("doc_id is not null"), 2)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "doc_id", "shard", "slot") == rows(placed, "doc_id", "shard", "slot")


def test_no_python_and_no_wide_sort(spark, sf_dir):
    plan = sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
