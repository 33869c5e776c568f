import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wildgrid.llm.mixing import mix, mixed_documents, plan_mix, sizes_of


@pytest.fixture(scope="module")
def uneven(spark):
    rows = []
    for source, count in (("big", 300), ("mid", 60), ("low", 25), (None, 10)):
        rows += [(source, " ".join(["w"] * (5 + i % 7))) for i in range(count)]
    rows = [(i, text, source) for i, (source, text) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_weights_reach_the_entropy(uneven):
    plan = plan_mix(sizes_of(uneven), target_entropy=0.8, max_repeats=1000).collect()
    weights = [r["weight"] for r in plan]
    assert abs(sum(weights) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weights)
    assert 0.8 * math.log(4) <= entropy < 0.8 * math.log(4) + 1e-4
    biggest = max(plan, key=lambda r: r["tokens"])
    assert biggest["quota"] == biggest["tokens"]


def test_repeats_are_limited(uneven):
    plan = plan_mix(sizes_of(uneven), target_entropy=1.0, max_repeats=3).collect()
    repeats = [r["quota"] / r["tokens"] for r in plan]
    assert max(repeats) <= 3.01 and max(repeats) > 2.9 and min(repeats) == 1


def test_stream_and_documents_agree(uneven):
    placed = mix(uneven, block_tokens=256)
    assert placed.where("block < 0").count() == 0
    uses = Counter(r["doc_id"] for r in placed.collect())
    copies = Counter(r["doc_id"] for r in mixed_documents(uneven, block_tokens=256).collect())
    assert uses == copies and set(uses) == set(range(395))
    slots = placed.groupBy("block").agg(F.count("*").alias("n"), F.max("slot").alias("top"),
                                        F.countDistinct("slot").alias("d"))
    assert slots.where("n <> top + 1 or n <> d").count() == 0


def test_every_block_holds_every_source_in_proportion(uneven):
    placed = mix(uneven, block_tokens=400).groupBy("block", "source").agg(F.sum("n_tokens").alias("t"))
    plan = {r["source"]: r for r in plan_mix(sizes_of(uneven), block_tokens=400).collect()}
    for r in placed.collect():
        share = plan[r["source"]]["quota"] / plan[r["source"]]["n_blocks"]
        assert abs(r["t"] - share) <= 24  # one document more or less at each end


def test_budget_below_the_corpus(uneven):
    total = mix(uneven, budget=1000).agg(F.sum("n_tokens")).first()[0]
    assert abs(total - 1000) < 50


def test_odd_rows(odd, empty):
    assert mixed_documents(odd).columns == odd.columns
    assert Counter(r["doc_id"] for r in mix(odd).collect()) == Counter(
        r["doc_id"] for r in mixed_documents(odd).collect())
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
