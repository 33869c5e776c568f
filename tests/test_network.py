"""Networks: slopes by differences, steps by hand, many nodes at once, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.operators import network, train
from wildgrid.operators.metrics import balanced_accuracy, pair_counts

NAMES = [f"f{i}" for i in range(4)]


def rows_of(spark, n, nodes=1, classes=3, seed=1):
    """Rows whose class is where their features are moved to; the third class is rare."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % 2 if i % 10 else 2
        x = random.normal(size=4) + 8 * np.eye(4)[c % classes]
        rows.append((i, f"n{i % nodes}", f"c{c % classes}", *(float(v) for v in x)))
    return spark.createDataFrame(rows, "id long, _node string, c string, f0 double, f1 double, f2 double, f3 double")


def loss(flat, sizes, x, label, weight):
    p = network.outputs(flat, sizes, x)[-1]
    return -(weight * np.log(p[np.arange(len(x)), label])).sum()


def test_gradient_against_differences():
    random, sizes = np.random.default_rng(3), (4, 4, 6, 5, 3)
    flat = network.first_weights(sizes, 1) + random.normal(size=network.n_weights(sizes)) / 10
    x, label, weight = random.normal(size=(9, 4)), random.integers(0, 3, 9), random.uniform(0.5, 2, 9)
    found = network.gradient(flat, sizes, x, label, weight)
    for at in range(len(flat)):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        slope = (loss(flat + step, sizes, x, label, weight) - loss(flat - step, sizes, x, label, weight)) / 2e-6
        assert abs(slope - found[at]) < 1e-4


@pytest.mark.parametrize("direct", [16, 0])
def test_two_batches_by_hand(spark, monkeypatch, direct):
    """Weights after the steps are those of plain Adam on the same batches, added up either way."""
    monkeypatch.setattr(network, "DIRECT", direct)
    monkeypatch.setattr(network, "BLOCK", 7)
    df = rows_of(spark, 60)
    (model, scores), = network.fit_networks(df, "c", NAMES, [0.05], {"n0": ["c0", "c1", "c2"]}, epochs=3, batches=2,
                                            hidden=(5,)).values()
    assert scores == [0.0]
    drawn = df.withColumn("b", F.pmod(F.xxhash64(F.xxhash64("id", F.lit(0))), F.lit(2))).collect()
    x = np.array([[r[f] for f in NAMES] for r in drawn])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    label, batch = np.array([int(r["c"][1]) for r in drawn]), np.array([r["b"] for r in drawn])
    weights = 60 / (3 * np.bincount(label))[label]
    sizes = (4, 4, 5, 3)
    flat = network.first_weights(sizes, [0, network.zlib.crc32(str(sizes).encode())])
    mean, square = 0, 0
    for step in range(1, 7):
        own = batch == (step - 1) % 2
        slope = network.gradient(flat, sizes, x[own], label[own], weights[own]) / weights[own].sum()
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        flat = flat - 0.05 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * mean / (np.sqrt(square) + 1e-7)
    assert np.allclose(model.flat, flat, rtol=1e-6, atol=1e-9)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    found = run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return jobs, found


def test_jobs_do_not_grow_with_nodes_folds_or_rates(spark):
    def fit(nodes, grid, k):
        df = rows_of(spark, 40 * nodes, nodes).withColumn("fold", (F.col("id") / nodes % k).cast("int"))
        classes = {f"n{i}": ["c0", "c1", "c2"] for i in range(nodes)}
        return network.fit_networks(df, "c", NAMES, grid, classes, k=k, epochs=2, batches=2)

    few, _ = jobs_of(spark, "net-few", lambda: fit(1, [0.01], 2))
    many, found = jobs_of(spark, "net-many", lambda: fit(9, [0.1, 0.01], 4))
    assert few == many and len(found) == 9
    assert all(len(scores) == 2 for _, scores in found.values())


def test_turns_give_the_same_models(spark, monkeypatch):
    df = rows_of(spark, 90, 3)
    classes = {f"n{i}": ["c0", "c1", "c2"] for i in range(3)}
    fit = lambda: network.fit_networks(df, "c", NAMES, [0.01], classes, epochs=1, batches=3)
    whole = fit()
    monkeypatch.setattr(network, "HELD_BYTES", 1)
    assert len(list(network._turns([network.Spec(0, -1, 0.1, (2, 3), 0, 1, None)] * 4))) == 4
    for node, (model, _) in fit().items():
        assert np.allclose(model.flat, whole[node][0].flat)


def test_tuned_swept_and_saved(spark, tmp_path):
    df = rows_of(spark, 400).withColumn("common_name", F.lit("x")).withColumn("public_positional_accuracy", F.lit(1.0))
    model, scores, _ = train.tune(df, "network", "c", NAMES, [0.00001, 0.02], k=2, epochs=8, batches=4)
    rows = {r["value"]: r["mean_score"] for r in scores.collect()}
    assert rows[0.02] > 0.95 > rows[0.00001]
    right = balanced_accuracy(pair_counts(model.transform(df), "c", "predicted")).first()[0]
    assert right > 0.95  # the rare class too
    model.save(spark, str(tmp_path), "Some Node")
    again = train.NodeModel.load(spark, str(tmp_path), "Some Node", "network")
    one = model.transform(df).orderBy("id").select("p", "predicted").collect()
    assert one == again.transform(df.drop("c")).orderBy("id").select("p", "predicted").collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in one)
    df = df.withColumn("family", F.concat(F.lit("F"), (F.col("c") == "c2").cast("string")))
    models, predictions, _ = train.sweep(df, ["family", "c"], NAMES, ["network", "tree"], k=2, root_target="family",
                                         grids={"network": [0.02], "tree": [2]})
    assert {kind for _, _, kind in models} == {"network", "tree"}
    assert predictions.select("node", "kind").distinct().count() == len(models)


def test_constant_feature_and_a_class_that_a_fold_lacks(spark):
    df = rows_of(spark, 60).withColumn("f3", F.lit(2.0)).withColumn("fold", (F.col("c") == "c2").cast("int"))
    (model, scores), = network.fit_networks(df, "c", NAMES, [0.01], {"n0": ["c0", "c1", "c2"]}, k=2, epochs=1).values()
    assert np.isfinite(model.flat).all() and len(scores) == 1
