import zlib

from pyspark.sql import functions as F

from tallyloom.llm import byte_shards as B
from tallyloom.llm.queries import QUERIES


def plain(rows, shards):
    """(doc_id, size) in order -> (shard, slot)."""
    total, at, out, used = sum(s for _, s in rows), 0, [], {}
    for doc_id, size in rows:
        shard = min(shards - 1, at * shards // max(1, total))
        out.append((doc_id, size, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + 1
        at += size
    return out


def test_query_equals_one_pass(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    sizes = [(i, len((t or "").encode()) + 16) for i, t in docs]
    got = QUERIES["op7_byte_shards"](spark, folder).collect()
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in got) == plain(sizes, 40)
    assert {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32((t or "").encode()) for i, t in docs}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    weight = {}
    for r in got:
        weight[r.shard] = weight.get(r.shard, 0) + r.size
    assert max(weight.values()) - min(weight.values()) <= 2 * max(s for _, s in sizes)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(3, None, 1), (1, "é", 1), (1, "é", 1), (2, "", 1), (None, "x" * 200_000, 1)], "doc_id long, text string, shard int")
    got = B.shard(B.sized(docs), 3).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 18), ("1", 18), ("2", 16), ("3", 16), ("None", 200_016)]
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert B.shard(B.sized(docs.limit(0)), 3).count() == 0


def test_many_partitions_give_the_same(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"), F.lit(0).alias("text_crc32"))
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        got = B.shard(rows.repartition(11), 40).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in got) == plain([(i, i % 97 + 1) for i in range(5000)], 40)
