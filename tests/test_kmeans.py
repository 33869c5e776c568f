"""Fits of all k and restarts together: against a plain loop, jobs, partitions, edge cases."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.operators import cluster, kmeans


def plain_lloyd(x, n, centres, steps=50):
    for _ in range(steps):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        own = d.argmin(1)
        after = np.array([np.average(x[own == c], axis=0, weights=n[own == c]) if (own == c).any() else centres[c]
                          for c in range(len(centres))])
        moved = ((after - centres) ** 2).sum(1).max()
        centres = after
        if moved <= 1e-8:
            break
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    return centres, float((d.min(1) * n).sum())


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(rng.integers(1, 5))) for a, b in np.round(rng.normal(size=(400, 2)) * 3, 2)]
    return spark.createDataFrame(rows, "x0 double, x1 double, n double").dropDuplicates(["x0", "x1"]).cache()


def jobs_of(spark, work):
    """Number of Spark jobs of a call."""
    sc = spark.sparkContext
    name = f"kmeans-{uuid.uuid4().hex}"
    sc.setJobGroup(name, name)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_like_a_plain_loop(spark, places):
    start = kmeans.first_centres(places, [3, 7], 2, 5)
    rows = places.collect()
    x, n = np.array([(r["x0"], r["x1"]) for r in rows]), np.array([r["n"] for r in rows])
    fits = kmeans.fit_all(places, [3, 7], 2, 5)[0]
    for k in (3, 7):
        centres, cost = min((plain_lloyd(x, n, start[0, k, r]) for r in range(2)), key=lambda f: f[1])
        assert fits[k].cost == pytest.approx(cost, rel=1e-9)
        assert np.allclose(fits[k].centres, centres)
    scores = kmeans.silhouettes(places, fits)
    for k in (3, 7):
        assigned = fits[k].transform(places).withColumn("v", F.array("x0", "x1"))
        assert scores[k] == pytest.approx(cluster.silhouette(assigned, "v", "prediction", "n").first()[0], abs=1e-9)


def test_partitions_do_not_matter(places):
    one, many = (kmeans.fit_all(places.repartition(p), [2, 5], 2, 1)[0] for p in (1, 13))
    for k in (2, 5):
        assert np.allclose(one[k].centres, many[k].centres)


def test_jobs_do_not_follow_the_values(spark, places):
    few = jobs_of(spark, lambda: kmeans.fit_all(places, [6], 1, 1, max_iter=3, tol=0))
    many = jobs_of(spark, lambda: kmeans.fit_all(places, range(2, 7), 5, 1, max_iter=3, tol=0))
    assert many <= few


def test_tables_apart(places):
    both = places.withColumn("table", F.lit(0)).unionByName(places.withColumn("x0", F.col("x0") + 100).withColumn("table", F.lit(1)))
    fits = kmeans.fit_all(both, [1, 3], 2, 1)
    alone = kmeans.fit_all(places, [1, 3], 2, 1)[0]
    assert np.allclose(fits[0][3].centres, alone[3].centres)
    assert fits[1][1].centres[0][0] == pytest.approx(alone[1].centres[0][0] + 100)


def test_few_points_and_none(spark, places):
    two = spark.createDataFrame([(0.0, 0.0, 5.0), (4.0, 0.0, 1.0)], "x0 double, x1 double, n double")
    fits = kmeans.fit_all(two, [1, 2, 5], 2, 1)[0]
    assert fits[5].k == 2 and fits[2].cost == fits[5].cost == 0 and fits[1].centres[0][0] == pytest.approx(4 / 6)
    assert kmeans.fit_all(places.where("false"), [2], 1, 1) == {}
    same = kmeans.silhouettes(two, {2: fits[2]})
    assert same[2] == pytest.approx(5 / 6)  # the point that stands alone counts nothing
