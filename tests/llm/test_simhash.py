import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from wildgrid.llm.components import connected_components
from wildgrid.llm.simhash import fingerprint, keep_representatives, linked, simhash_components


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


@pytest.mark.parametrize("text", ["", "  ", "A", "a B", "a b c", "É x y z", "The quick brown\tfox\x0bjumps " * 9])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == brute(text)


def test_components_of_random_edges(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(500, 500), (None, 1)]
    edges += [(400, 400 + i) for i in range(1, 60)]  # a hub
    found = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert found == {n: c for n, c in classes({x for e in real for x in e}, real).items() if n != c}


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_links_against_all_pairs(spark, parts):
    random.seed(5)
    prints = [random.getrandbits(64) for _ in range(120)]
    for base in list(prints[:40]):  # chains of neighbours at 1 to 4 bits
        for _ in range(4):
            for bit in random.sample(range(64), random.randint(1, 4)):
                base ^= 1 << bit
            prints.append(base)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = classes(range(len(prints)), edges)
    found = linked(spark.createDataFrame(rows, "doc_id long, fp long"), parts=parts, tile_rows=16).collect()
    by_print = {r["fp"]: r["component"] for r in found}
    assert {i: by_print[p] for i, p in rows} == want


def test_group_of_near_copies(spark):
    base = random.Random(1).getrandbits(63)
    rows = [(i, base ^ (1 << (i % 60)) ^ (1 << (i * 7 % 60))) for i in range(3000)]
    found = linked(spark.createDataFrame(rows, "doc_id long, fp long"), tile_rows=200)
    assert found.select("component").distinct().count() == 1


def test_odd_rows(odd, empty):
    rows = simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert by[1] == by[2] and by[1][1] == 1
    assert by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert by[6][1] == by[7][1] == 6
    assert simhash_components(empty).count() == 0


def test_representatives(odd, empty):
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 3, 6, 8, 9, 10, 11]
    assert kept.where(F.col("doc_id").isNull()).count() == 2
    assert keep_representatives(empty).count() == 0


def test_one_id_on_different_texts(spark):
    words = [" ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for i in range(3)]
    docs = spark.createDataFrame([(5, words[0]), (5, words[1]), (1, words[1]), (7, words[2])], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in keep_representatives(docs).collect())
    assert kept == sorted([(5, words[0]), (1, words[1]), (7, words[2])])


def test_one_id_on_unrelated_texts(spark):
    words = [" ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for i in range(3)]
    docs = spark.createDataFrame([(5, words[0]), (5, words[1]), (3, words[1]), (7, words[0]), (9, words[2])],
                                 "doc_id long, text string")
    # The texts of 5 are no copies of each other: no group may join through the id.
    by_text = {r["fingerprint"]: set() for r in simhash_components(docs).collect()}
    for r in simhash_components(docs).collect():
        by_text[r["fingerprint"]].add(r["component_id"])
    assert sorted(map(sorted, by_text.values())) == [[3], [5], [9]]
    kept = sorted((r["doc_id"], r["text"]) for r in keep_representatives(docs).collect())
    assert kept == sorted([(5, words[0]), (3, words[1]), (9, words[2])])


def test_two_texts_of_one_id_stay(spark):
    words = [" ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for i in range(2)]
    docs = spark.createDataFrame([(5, words[0]), (5, words[1]), (5, words[1])], "doc_id long, text string")
    assert sorted(r["text"] for r in keep_representatives(docs).collect()) == sorted(words)


def test_links_through_rows_without_an_id(spark):
    rows = [(1, 0), (None, 0b111), (2, 0b111111), (None, (1 << 40) - 1)]
    found = {r["fp"]: r["component"] for r in linked(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert found == {0: 1, 0b111: 1, 0b111111: 1, (1 << 40) - 1: None}
