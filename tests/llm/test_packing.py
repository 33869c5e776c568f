import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wildgrid.llm.packing import first_fit_decreasing, pack


def naive(lengths, room):
    free, out = [], {}
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((i for i, f in enumerate(free) if f >= lengths[piece]), None)
        if at is None:
            at = len(free)
            free.append(room)
        out[piece] = (at, room - free[at])
        free[at] -= lengths[piece]
    return [out[i] for i in range(len(lengths))]


def test_first_fit_decreasing_against_naive():
    drawn = np.random.default_rng(2)
    for size in (1, 2, 3, 17, 200):
        for _ in range(10):
            lengths = drawn.integers(1, 65, size).tolist()
            bins, offsets = first_fit_decreasing(lengths, 64)
            assert list(zip(bins.tolist(), offsets.tolist())) == naive(lengths, 64)


def check(docs, rows, length):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), length):
            part = np.array(ids[at:at + length], dtype="<u4")
            want[d["doc_id"]].append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in found.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return sequences


def test_round_trip_of_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pack(docs).collect()
    sequences = check(docs.collect(), rows, 1024)
    filled = sum(r["length"] for r in rows)
    assert filled / (1024 * len(sequences)) > 0.97


def test_odd_rows_in_small_groups(odd, empty):
    check(odd.collect(), pack(odd, length=64, group_pieces=50).collect(), 64)
    assert pack(empty).count() == 0


def test_added_tokens_inside_texts(spark):
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "<|endoftext |>", " <|endoftext|>\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pack(docs).collect()
    check(docs.collect(), rows, 1024)
    assert next(r["doc_tokens"] for r in rows if r["doc_id"] == 0) == 5


def test_partitions_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = [sorted(map(tuple, pack(docs.repartition(n), group_pieces=64).collect())) for n in (1, 4)]
    assert packed[0] == packed[1]
