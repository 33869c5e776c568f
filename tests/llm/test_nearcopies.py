import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from wildgrid.llm.nearcopies import RADIUS, band_of, keep_one_of_each, shingle_set, wide_fingerprint


def brute_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(sets):
    """All pairs of different sets with a similarity of 0.8 or more."""
    holders = defaultdict(list)
    for at, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(at)
    pairs = set()
    for at, s in enumerate(sets):
        common = Counter(j for shingle in s for j in holders[shingle] if j < at)
        pairs.update((at, j) for j, n in common.items() if n / (len(s) + len(sets[j]) - n) >= 0.8)
    return pairs


def least_of_groups(rows):
    """Least id of each group of (id, text)."""
    label = {}
    for i, text in rows:
        label.setdefault(found := brute_set(text), i)
        label[found] = min(label[found], i)
    sets = list(label)
    pairs = similar_pairs(sets)
    while True:
        before = dict(label)
        for a, b in pairs:
            label[sets[a]] = label[sets[b]] = min(label[sets[a]], label[sets[b]])
        if before == label:
            return set(label.values()), pairs


def words(seed, n):
    return random.Random(seed).choices([f"w{i}" for i in range(5000)], k=n)


@pytest.mark.parametrize("size", ["sf0.01"])
def test_stage_against_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, pairs = least_of_groups(rows)
    assert pairs
    left = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()]
    assert Counter(left) == Counter(want)


def test_recall_of_the_radius():
    tried = found = 0
    for size in (5, 6, 9, 10, 20, 50, 200, 1000):
        for seed in range(100):
            hashes = np.random.default_rng([size, seed]).integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            most = int(size / 9)  # replaced ones: (size - most) / (size + most) >= 0.8
            pairs = [(hashes[:size], hashes[most:size + most])]
            pairs += [(hashes[:size], hashes[:-(-4 * size // 5)])]
            for a, b in pairs:
                a, b = np.sort(a), np.sort(b)
                bits = np.bitwise_count(wide_fingerprint(a) ^ wide_fingerprint(b)).sum()
                tried, found = tried + 1, found + (bits <= RADIUS)
                assert band_of(len(a)) - band_of(len(b)) <= 1 or len(b) < 4
    assert found == tried


def test_edits_and_edges(spark):
    base = words(1, 104)
    one, two, many = base.copy(), base.copy(), base.copy()
    one[50] = two[10] = two[60] = "x"
    many[10] = many[40] = many[70] = "x"
    nine = words(2, 9)  # 5 shingles, and 4 of them without the last word: exactly 0.8
    rows = [(1, base), (2, one), (3, two), (4, many), (5, nine), (6, nine[:8]), (7, nine[:7]), (8, []), (9, []),
            (10, ["a"]), (11, ["A"]), (12, ["b"])]
    rows = [(i, " ".join(t)) for i, t in rows]
    want, _ = least_of_groups(rows)
    found = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    assert {1, 5, 7, 8, 10, 12} <= want and not {2, 3, 6, 9, 11} & want


def test_group_over_many_tiles(spark):
    base, rows = words(3, 120), []
    for i in range(150):
        text = base.copy()
        for at in random.Random(i).sample(range(120), 1 + i % 4):
            text[at] = f"edit{i}"
        rows.append((i, " ".join(text)))
    want, _ = least_of_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in keep_one_of_each(docs, tile_shingles=1500).collect())
    assert found == sorted(want) and len(found) < len(rows)


def test_rows_without_or_with_the_same_id(spark, odd, empty):
    a, b, c = (" ".join(words(i, 60)) for i in (4, 5, 6))
    rows = [(5, a), (5, b), (3, b + " end"), (5, a + " end"), (None, c), (None, c), (None, a), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["text"][:9]) for r in keep_one_of_each(docs).collect())
    assert found == sorted([(5, a[:9]), (3, b[:9]), (0, c[:9])])
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 8, 9, 10, 11]
    assert keep_one_of_each(empty).count() == 0


def test_maps_and_structs_in_other_columns(spark):
    same, other = "one two three four five six", "another text of a few words"
    rows = [(4, same, {"k": 4}, ({4: 1},)), (2, same, {"k": 2}, None), (9, same, None, ({9: 1},)),
            (102, other, {"k": 1}, ({5: 1},)), (104, other, {"k": 1}, ({5: 1},)), (104, other, {"k": 1}, ({5: 1},))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,long>, s struct<deep: map<long,int>>")
    left = sorted(r["doc_id"] for r in keep_one_of_each(docs).collect())
    assert left == [2, 102]
