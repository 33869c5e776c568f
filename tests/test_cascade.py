"""The cascade against a row-by-row descent written in Python."""

import random

import pytest

from wildgrid.operators import cascade

TREE = {"base": ["A", "B"], "A": ["A1"], "A1": ["A1x", "A1y", "A1z"], "B": ["B1", "B2"], "B1": ["B1x", "B1y"]}
LEVELS = ["family", "genus", "species"]
WEIGHTS = {"family": 0.1, "genus": 0.2, "species": 0.5}


def make(seed, n=120):
    rnd = random.Random(seed)
    truth, scores = {}, []
    for i in range(n):
        path, node = [], "base"
        for _ in LEVELS:
            children = TREE.get(node)
            node = rnd.choice(children) if children and node is not None else None
            path.append(node)
        if rnd.random() < 0.2:
            path[2] = None
        truth[i] = path
        for node, children in TREE.items():
            if len(children) < 2:
                continue
            level = LEVELS[0] if node == "base" else LEVELS[1] if node in ("A", "B") else LEVELS[2]
            for order, child in enumerate(sorted(children)):
                bonus = 1.5 if child in path else 0
                scores.append((i, "meta", None, level, node, child, order, rnd.random() + bonus))
                for part in "ab"[: 1 + i % 2]:
                    scores.append((i, "image", part, level, node, child, order, rnd.random() + bonus))
    return truth, scores


def descend_one(i, path, scores, stop):
    out, node = [], "base"
    mine = [s for s in scores if s[0] == i]
    for number, level in enumerate(LEVELS):
        children = TREE.get(node)
        if not children:
            break
        if len(children) == 1:
            node = children[0]
            continue
        children = sorted(children)
        meta = [next(s[7] for s in mine if s[1] == "meta" and s[4] == node and s[5] == c) for c in children]
        image = []
        for c in children:
            parts = [s[7] for s in mine if s[1] == "image" and s[4] == node and s[5] == c]
            image.append(sum(parts) / len(parts))
        image = [v / sum(image) for v in image]
        w = WEIGHTS[level]
        joint = [m * w + v * (1 - w) for m, v in zip(meta, image)]
        pick = lambda v: children[v.index(max(v))]
        if path[number] is None:
            break
        out.append((i, level, pick(joint), pick(image), pick(meta), path[number]))
        node = pick(joint)
        if stop and node != path[number]:
            break
    return out


@pytest.mark.parametrize("stop", [True, False])
def test_same_as_one_by_one(spark, stop):
    truth, scores = make(5)
    t = spark.createDataFrame([(i, *p) for i, p in truth.items()], "id long, family string, genus string, species string")
    s = spark.createDataFrame(scores, "id long, source string, suffix string, level string, node string, "
                                      "class string, ordinal int, p double")
    edges = cascade.hierarchy_edges(spark.createDataFrame(
        [("A", "A1", x) for x in TREE["A1"]] + [("B", "B1", x) for x in TREE["B1"]] + [("B", "B2", None)],
        "family string, genus string, species string"), LEVELS)
    got = sorted(map(tuple, cascade.cascade(s, t, edges, LEVELS, WEIGHTS, stop_on_miss=stop).collect()))
    expected = sorted(r for i, p in truth.items() for r in descend_one(i, p, scores, stop))
    assert got == expected and len(got) > 100


def test_missing_readings_stop_the_descent(spark):
    truth, scores = make(6, 10)
    broken = [s if not (s[0] == 3 and s[1] == "meta" and s[4] == "base") else (*s[:7], None) for s in scores]
    t = spark.createDataFrame([(i, *p) for i, p in truth.items()], "id long, family string, genus string, species string")
    s = spark.createDataFrame(broken, "id long, source string, suffix string, level string, node string, "
                                      "class string, ordinal int, p double")
    edges = cascade.hierarchy_edges(t, LEVELS)
    ids = {r["id"] for r in cascade.cascade(s, t, edges, LEVELS, WEIGHTS).collect()}
    assert 3 not in ids and len(ids) == 9
