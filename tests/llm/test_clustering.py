import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.llm import clustering
from wildgrid.llm.clustering import Centroids, cluster_vectors, first_centroids, fit, valid_vectors


def nearest_two(rows, centres):
    d = ((rows[:, None, :].astype(object) - centres[None].astype(object)) ** 2).sum(axis=2)
    order = [sorted(range(len(centres)), key=lambda j: (line[j], j)) for line in d]
    return np.array([o[0] for o in order]), d


def naive(vectors, clusters, rounds, scale=1024, seed=3):
    """Assignments, distances and centroids of (id, vector) rows by comparing everything with everything."""
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors]
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
    centres = [v for _, v in start[:clusters]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in rows]
    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(rows, found) if j == k]
            if own:
                centres[k] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, k, d) for (i, _), (d, k) in zip(rows, assign())], centres


def test_bounds_give_the_exact_nearest_over_many_rounds():
    drawn = np.random.default_rng(5)
    for clusters, spread in ((2, 3), (5, 2), (12, 40)):  # small spreads give many ties
        rows = drawn.integers(-spread, spread, (400, 4))
        centroids = Centroids(rows[:clusters])
        near, second = np.full(400, -1), np.full(400, -1)
        upper, lower = np.zeros(400), np.zeros(400)
        for _ in range(8):
            near, second, upper, lower = centroids.assign(rows, near, second, upper, lower)
            wanted, d = nearest_two(rows, centroids.rows)
            assert (near == wanted).all() and (second != near).all()
            own = d[np.arange(400), near].astype(float) ** 0.5
            rest = np.array([min(x for j, x in enumerate(line) if j != n) for line, n in zip(d, near)]).astype(float) ** 0.5
            assert (upper >= own).all() and (lower <= rest).all()
            moved = np.array([rows[near == k].sum(axis=0) // max(1, (near == k).sum()) if (near == k).any()
                              else centroids.rows[k] for k in range(clusters)])
            centroids = Centroids(moved, centroids)


def test_bounds_spare_distances(monkeypatch):
    """Groups far apart: after the first rounds hardly any vector is compared with all centroids."""
    drawn = np.random.default_rng(1)
    rows = np.vstack([drawn.integers(-20, 20, (200, 8)) + 10_000 * i for i in range(16)])
    centroids, looked = Centroids(rows[::200] + 3), []
    inner = Centroids.search
    monkeypatch.setattr(Centroids, "search", lambda self, r, *a: (looked.append(len(r)), inner(self, r, *a))[1])
    state = (np.full(3200, -1), np.full(3200, -1), np.zeros(3200), np.zeros(3200))
    for _ in range(3):
        state = centroids.assign(rows, *state)
        centroids = Centroids(centroids.rows + 1, centroids)
    assert looked[0] == 3200 and looked[1:] == [0, 0]


def rows_of(spark, vectors, kind="array<float>"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding {kind}")


@pytest.mark.parametrize("clusters", [1, 3, 8])
def test_against_everything_with_everything(spark, clusters):
    drawn = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in drawn.integers(-3, 3, 6) / 4]) for i in range(150)]
    found = cluster_vectors(rows_of(spark, vectors), dimensions=6, clusters=clusters).collect()
    wanted, centres = naive(vectors, clusters, 10)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == sorted(wanted)
    for r in found:
        assert r["inertia"] == sum(d for *_, d in wanted)
        assert r["cluster_inertia"] == sum(d for _, k, d in wanted if k == r["cluster"])
        text = ",".join(map(str, centres[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1, -0.2]), (None, [5.0, 5.0]), (7, [0.0, 0.0])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (8, [nan, 0.0]), (9, [0.0, -inf]), (10, [1.0, 2.0, 3.0]),
           (11, [1e20, 0.0])]
    rows = rows_of(spark, good + bad, "array<double>").withColumn("cluster", F.lit("mine")).withColumn("values", F.lit(1))
    found = cluster_vectors(rows, dimensions=2, clusters=3, rounds=4)
    wanted, _ = naive(good, 3, 4)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=key) == sorted(wanted, key=key)
    assert cluster_vectors(rows.where("vec_id > 2 and vec_id < 6"), dimensions=2).count() == 0
    assert cluster_vectors(rows.where("false"), dimensions=2).columns == found.columns


def test_wide_numbers_stay_exact(spark):
    vectors = [(i, [float((i * 37 % 11) * 10 ** 9), float(i * 10 ** 8), -3.0]) for i in range(40)]
    found = cluster_vectors(rows_of(spark, vectors, "array<double>"), dimensions=3, clusters=4, rounds=3).collect()
    wanted, _ = naive(vectors, 4, 3)
    fits = {i: (k, d if d < 2 ** 63 else None) for i, k, d in wanted}
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in found} == fits


def test_partitions_do_not_matter(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    one = sorted(map(tuple, cluster_vectors(rows.coalesce(1)).collect()))
    assert one == sorted(map(tuple, cluster_vectors(rows.repartition(5)).collect()))
    assert first_centroids(valid_vectors(rows)) == first_centroids(valid_vectors(rows.repartition(3)))
    state, centroids = fit(rows, rounds=0)
    assert centroids.rows.tolist() == first_centroids(valid_vectors(rows)) and state.count() == rows.count()
    assert clustering.CLUSTERS == 8
