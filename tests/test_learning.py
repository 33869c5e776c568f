"""Models on separable points: quality floors, persistence, cascade with models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.operators import cascade, cluster, features, train
from wildgrid.operators.metrics import balanced_accuracy, pair_counts
from wildgrid.plans.modelling import sweep_reports

NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    """Four groups of points; two families with two genera each."""
    rng = np.random.default_rng(7)
    centres = {"G0": (0, 0), "G1": (6, 0), "G2": (0, 6), "G3": (6, 6)}
    rows = []
    for g, (name, (cx, cy)) in enumerate(centres.items()):
        for k in range(40 + 10 * g):
            dx, dy = rng.normal(size=2)
            rows.append((len(rows), f"F{g // 2}", name, "animal", 5.0, float(cx + dx), float(cy + dy)))
    return spark.createDataFrame(rows, "id long, family string, genus string, common_name string, "
                                       "public_positional_accuracy double, x double, y double").cache()


def score(model, df, target="genus"):
    return balanced_accuracy(pair_counts(model.transform(df), target, "predicted")).first()[0]


@pytest.mark.parametrize("kind,value,options,floor", [
    ("tree", 3, {}, 0.9), ("forest", 3, {"trees": 5}, 0.9), ("boosted", 2, {"iterations": 3}, 0.85),
    ("stumps", 6, {}, 0.8), ("stumps", 6, {"method": "discrete"}, 0.5),
    ("network", 0.01, {}, 0.9), ("linear", 0.0, {}, 0.9)])
def test_quality_and_probabilities(spark, points, kind, value, options, floor):
    model = train.fit_node(points, kind, "genus", NAMES, value, **options)
    rows = model.transform(points).collect()
    for r in rows[:20]:
        assert r["classes"] == ["G0", "G1", "G2", "G3"]
        assert abs(sum(r["p"]) - 1) < 1e-6 and len(r["p"]) == 4
    assert score(model, points) >= floor


def test_binary_boosting(points):
    for method in ("real", "discrete"):
        model = train.fit_node(points, "stumps", "family", NAMES, 3, method=method)
        assert score(model, points, "family") > 0.95
    model = train.fit_node(points, "boosted", "family", NAMES, 2, iterations=3)
    assert score(model, points, "family") > 0.9
    assert len(model.transform(points).first()["p"]) == 2


def test_tuning_refits_the_first_best(spark, points):
    model, scores, rejects = train.tune(points, "tree", "genus", NAMES, [1, 3], k=2)
    assert rejects.count() == 0
    rows = {r["value"]: r["mean_score"] for r in scores.collect()}
    assert rows[3.0] > rows[1.0]
    assert model.depth > 1
    assert train.depth_grid(53, 2)[-1] == 51 and train.depth_grid(53, 10)[-1] == 51
    assert train.default_grid("tree", 53)[-1] == 51 and train.default_grid("boosted", 53) == [1, 11, 21, 31, 41, 51]
    assert train.default_grid("tree", 53, max_depth=30)[-1] == 29
    with pytest.raises(ValueError):
        train.fit_node(points, "tree", "genus", NAMES, 0)
    best = cluster.first_best(spark.createDataFrame([(1, 0.5), (3, 0.9), (5, 0.9)], "k int, s double"), "s", "k").first()
    assert best["k"] == 3


def test_saved_models_give_the_same(spark, points, tmp_path):
    for kind, value in (("tree", 3), ("stumps", 3)):
        model = train.fit_node(points, kind, "genus", NAMES, value)
        model.save(spark, str(tmp_path), "Some Family")
        again = train.NodeModel.load(spark, str(tmp_path), "Some Family", kind)
        assert again.classes == model.classes
        a = model.transform(points).orderBy("id").select("predicted").collect()
        b = again.transform(points.drop("genus")).orderBy("id").select("predicted").collect()
        assert a == b
    from wildgrid.sources import registry
    clusters = cluster.fit_kmeans(cluster.distinct_points(points, NAMES), 4, restarts=1)
    registry.save_clusters(spark, clusters, str(tmp_path), "Some Family")
    again = registry.load_clusters(spark, str(tmp_path), "Some Family")
    assert [list(c) for c in again.clusterCenters()] == [list(c) for c in clusters.clusterCenters()]
    kinds = {r["kind"] for r in registry.registered(spark, str(tmp_path)).collect()}
    assert kinds == {"tree", "stumps", "k_means"}


def test_sweep_and_cascade(spark, points, tmp_path):
    models, predictions, rejects = train.sweep(points, ["family", "genus"], NAMES, ["tree"],
                                      grids={"tree": [3]}, k=2, root_target="family", save_to=str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 3
    assert set(models) == {("family", "base", "tree"), ("genus", "F0", "tree"), ("genus", "F1", "tree")}
    assert rejects.count() == 0
    report, accuracy = sweep_reports(predictions)
    assert min(r["accuracy"] for r in accuracy.collect()) > 0.8
    assert report.where("node = 'F0'").select("label").distinct().count() == 2
    edges = cascade.hierarchy_edges(points, ["family", "genus"])
    meta = {(level, n): m for (level, n, _), m in models.items()}
    image = {(level, n): train.fit_node(points if n == "base" else points.where(f"family = '{n}'"), "linear",
                                        m.target, NAMES, 0.0)
             for (level, n), m in meta.items()}
    weights, levels = {"family": 0.1, "genus": 0.2}, ["family", "genus"]
    results, lost = cascade.cascade_with_models(points, edges, levels, meta, image, weights)
    assert results.where("taxonomic_level = 'family'").count() == points.count()
    right = results.where("taxonomic_level = 'family' and joint_prediction = true_label").count()
    assert results.where("taxonomic_level = 'genus'").count() == right and lost.count() == 0
    blind, lost = cascade.cascade_with_models(points.drop("family", "genus"), edges, levels, meta, image,
                                              weights, labelled=False)
    assert blind.count() == 2 * points.count() and lost.count() == 0


def test_every_row_is_accounted_for(spark, points):
    """A null in each feature, no model at a node, no label: results and rejects hold all rows."""
    broken = points.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x"))) \
                   .withColumn("y", F.when(F.col("id") % 10 != 1, F.col("y"))) \
                   .withColumn("genus", F.when(F.col("id") % 10 != 2, F.col("genus")))
    _, scores, rejects = train.tune(broken, "tree", "genus", NAMES, [2], k=2)
    counts = {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()}
    some = {i: points.where(f"id % 10 = {i}").count() for i in (0, 1, 2)}
    assert counts == {"null in x": some[0], "null in y": some[1], "no label": some[2]}
    models, predictions, rejects = train.sweep(broken, ["family", "genus"], NAMES, ["tree"], grids={"tree": [3]},
                                               k=2, root_target="family")
    used = broken.where("genus is not null").count()
    assert rejects.where("level = 'family'").count() == some[0] + some[1]
    assert rejects.where("level = 'genus'").select("id").distinct().count() == some[0] + some[1] and used > 0
    edges = cascade.hierarchy_edges(points, ["family", "genus"])
    meta = {(level, n): m for (level, n, _), m in models.items() if n != "F1"}
    results, lost = cascade.cascade_with_models(broken, edges, ["family", "genus"], meta, meta,
                                                {"family": 0.1, "genus": 0.2})
    reasons = {r["reason"] for r in lost.select("reason").distinct().collect()}
    assert reasons == {"null feature", "no model", "no label"}
    seen = results.select("id").union(lost.select("id")).distinct()
    assert seen.count() == points.count()
    blind, lost = cascade.cascade_with_models(points, edges, ["family", "genus"], {}, {}, {"family": 0.1}, labelled=False)
    assert blind.count() == 0 and lost.where("reason = 'no model'").count() == points.count()


def test_clusters(spark, points):
    places = cluster.distinct_points(points, NAMES)
    model, scores = cluster.choose_k(places, ks=[2, 4, 6], restarts=2)
    assert model.k == 4 and [k for k, _ in scores] == [2, 4, 6]
    assert cluster.dispersion(places, 1) > cluster.dispersion(places, 4, 2)
    with pytest.raises(ValueError):
        cluster.choose_k(places.limit(3), ks=[4])
    gaps = cluster.gap_statistic(spark, places, [1, 4], references=2, box="data").collect()
    assert gaps[1]["gap"] > gaps[0]["gap"]
    moved = features.location_cluster(points.withColumnsRenamed({"x": "latitude", "y": "longitude"}), model)
    assert moved.select("location_cluster").distinct().count() == 4


def test_silhouette_by_hand(spark, points):
    rows = [(r["x"], r["y"], int(r["genus"][1])) for r in points.collect()]
    rows += rows[:25]  # repeated places
    rows.append((50.0, 50.0, 9))  # a cluster of one
    x = np.array([(a, b) for a, b, _ in rows])
    own = np.array([c for _, _, c in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    total = 0.0
    for i in range(len(rows)):
        size = (own == own[i]).sum()
        if size > 1:
            a = d[i][own == own[i]].sum() / (size - 1)
            b = min(d[i][own == c].mean() for c in set(own) if c != own[i])
            total += (b - a) / max(a, b)
    df = spark.createDataFrame(rows, "x double, y double, c int").withColumn("v", F.array("x", "y"))
    got = cluster.silhouette(df, "v", "c").first()[0]
    assert got == pytest.approx(total / len(rows), abs=1e-9)
    weighted = df.groupBy("v", "c").agg(F.count("*").alias("n"))
    assert cluster.silhouette(weighted, "v", "c", "n").first()[0] == pytest.approx(total / len(rows), abs=1e-9)


def test_network_columns_are_the_same_for_new_rows(spark):
    rows = [(i, i % 3, i % 5, i % 4 + 1, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, location_cluster int, hour int, month int, elevation double")
    table, encoders, scaler = features.network_features(df, "genus")
    new, _, _ = features.network_features(df.where("hour = 9 or id < 2"), "genus", encoders=encoders, scaler=scaler)
    assert new.columns == table.columns and "hr_0" not in table.columns and "loc_2" in table.columns
    mean, std = table.agg(F.avg("elevation"), F.stddev_pop("elevation")).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9
