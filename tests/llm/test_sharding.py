import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wildgrid.llm.sharding import minimax_cuts, shard_documents


def smallest(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                used, held = used + 1, 0
            held += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def test_capacity_against_search(spark):
    import random

    random.seed(4)
    for count in (1, 5, 60):
        sizes = [random.randint(1, 100) for _ in range(count)]
        ranges = spark.createDataFrame([(f"{i:04x}", s) for i, s in enumerate(sizes)], "range string, bytes long")
        for shards in (1, 3, 8):
            row = minimax_cuts(ranges, shards).first()
            assert row["capacity"] == max(smallest(sizes, shards), -(-sum(sizes) // shards))
            assert len(row["cuts"]) < shards


def test_shards_of_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = shard_documents(docs, shards=8).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    where, slots, held = {}, defaultdict(list), defaultdict(int)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        assert where.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) <= sum(held.values()) / 8 + max(len(t) for t in texts.values()) * 2


def test_odd_rows(odd, empty):
    rows = shard_documents(odd)
    assert rows.count() == odd.count()
    assert rows.where("doc_id in (3, 4)").select("shard").distinct().count() == 1
    assert rows.where("doc_id = 4 and size = 16 and text_crc32 = 0").count() == 1
    assert rows.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).where("m <> n - 1").count() == 0
    assert shard_documents(empty).count() == 0
