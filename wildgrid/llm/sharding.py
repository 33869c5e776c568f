"""Sharding by the smallest largest shard over contiguous runs of groups.

Rows with equal texts are one group and never parted. Groups are ordered by a
hash of their text and cut into shards at places of that order. The smallest
capacity with which the shards hold everything is found by binary search: a
check fills shards one after the other, opening a new one whenever the next
size does not fit. Checks run over the sizes of hash ranges, a list of bounded
length whatever the number of rows. DataFrame operations only.
"""

from pyspark.sql import functions as F

from ..operators.ranks import exact_rank
from ..operators.storage import settle
from .common import bind

SHARDS = 40
# Hash ranges: all texts of a range stay together; 2^16 / 40 ranges in a shard
# keep the shards within about a thousandth of the best possible sizes.
RANGE_DIGITS = 4
ROW_BYTES = 16


def _shards_needed(sizes, capacity):
    """Shards that filling one after the other opens at this capacity."""
    start = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("held"))

    def add(acc, size):
        fits = acc["held"] + size <= capacity
        return F.struct(F.when(fits, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
                        F.when(fits, acc["held"] + size).otherwise(size).alias("held"))

    return F.aggregate(sizes, start, add, lambda acc: acc["n"])


def minimax_cuts(ranges, shards):
    """One row (capacity, cuts): the smallest capacity with at most ``shards`` shards.

    ``ranges`` has (range, bytes), one row per hash range: a bounded table. The
    largest size and the mean over the shards bound the capacity from below,
    their sum bounds it from above. ``cuts`` are the ranges that begin a shard,
    but for the first one.
    """
    rows = F.array_sort(F.collect_list(F.struct("range", "bytes")))
    row = ranges.agg(rows.alias("rows"), F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("most"),
                     F.ceil(F.coalesce(F.sum("bytes"), F.lit(0)) / shards).cast("long").alias("mean"))
    row = row.withColumn("sizes", F.transform("rows", lambda r: r["bytes"]))

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("long")
        return F.when(acc["low"] >= acc["high"], acc).otherwise(bind(
            _shards_needed(F.col("sizes"), middle) <= shards, lambda enough: F.struct(
                F.when(enough, acc["low"]).otherwise(middle + 1).alias("low"),
                F.when(enough, middle).otherwise(acc["high"]).alias("high"))))

    first = F.struct(F.greatest("mean", "most").alias("low"), (F.col("mean") + F.col("most")).alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.col("most") + 2)).cast("int") + 2)
    found = settle(row.select("rows", F.aggregate(steps, first, halve, lambda acc: acc["high"]).alias("capacity")),
                   "capacity")

    def cut(acc, r):
        fits = acc["held"] + r["bytes"] <= F.col("capacity")
        return F.struct(F.when(fits, acc["held"] + r["bytes"]).otherwise(r["bytes"]).alias("held"),
                        F.when(fits, acc["cuts"]).otherwise(F.array_append(acc["cuts"], r["range"])).alias("cuts"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<string>").alias("cuts"))
    return found.select("capacity", F.aggregate("rows", start, cut, lambda acc: acc["cuts"]).alias("cuts"))


def shard_documents(docs, doc_id="doc_id", text="text", shards=SHARDS):
    """(doc_id, size, text_crc32, shard, slot) of every row.

    Size is the UTF-8 bytes of the text (none if null) plus 16. A null text is
    in the group of the empty ones. Slots count from 0 without gaps in each
    shard, by hash range, checksum, id and size; rows that repeat all of these
    are alike. With fewer groups than shards some shards stay empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = settle(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.substr(F.md5(whole.cast("binary")), F.lit(1), F.lit(RANGE_DIGITS)).alias("range")), "sized")
    ranges = settle(sized.groupBy("range").agg(F.sum("size").alias("bytes")), "ranges")
    cuts = F.array(*map(F.lit, minimax_cuts(ranges, shards).first()["cuts"])).cast("array<string>")
    shard = F.size(F.filter(cuts, lambda c: c <= F.col("range")))
    ranked = exact_rank(sized.withColumn("shard", shard), ["range", "text_crc32", "doc_id", "size"], "shard", "_rank")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).alias("slot"))
