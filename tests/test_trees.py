"""Trees from histograms against trees grown by hand, many nodes at once, deep trees, saved rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.operators import train, trees
from wildgrid.operators.metrics import balanced_accuracy, pair_counts


def table(spark, rows, width):
    names = [f"x{i}" for i in range(width)]
    schema = "id long, _node string, label string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), names


def drawn(seed, n, width, classes, nodes=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.integers(0, 12, width).astype(float)
        label = int(x[0] > 5) * 2 + int(x[1] + x[2] > 11) if rng.random() > 0.1 else int(rng.integers(classes))
        out.append((i, f"N{i % nodes}", f"C{label % classes}", *map(float, x)))
    return out


def purity(w):
    return (w ** 2).sum() / w.sum() if w.sum() > 0 else 0.0


def by_hand(x, y, w, classes, depth):
    """Class shares of every row from greedy cuts that raise the purity most; ties: first feature."""
    def grow(rows, left):
        total = np.array([w[rows][y[rows] == c].sum() for c in range(classes)])
        best = (1e-9 * total.sum(), None)
        if left:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    a = rows[x[rows, f] <= cut]
                    part = np.array([w[a][y[a] == c].sum() for c in range(classes)])
                    gain = purity(part) + purity(total - part) - purity(total)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
        if best[1] is None:
            return [(rows, total / total.sum())]
        f, cut = best[1]
        go = x[rows, f] <= cut
        return grow(rows[go], left - 1) + grow(rows[~go], left - 1)

    p = np.zeros((len(y), classes))
    for rows, share in grow(np.arange(len(y)), depth):
        p[rows] = share
    return p


@pytest.mark.parametrize("depth", [1, 3])
def test_tree_against_cuts_by_hand(spark, depth):
    rows = drawn(3, 300, 4, 4)
    df, names = table(spark, rows, 4)
    model = train.fit_node(df, "tree", "label", names, depth)
    x = np.array([r[3:] for r in rows])
    y = np.array([int(r[2][1:]) for r in rows])
    sizes = np.bincount(y, minlength=4)
    wanted = by_hand(x, y, (len(y) / (4 * sizes))[y], 4, depth)
    found = {r["id"]: r["p"] for r in model.transform(df).collect()}
    assert np.allclose([found[i] for i in range(300)], wanted, atol=1e-9)
    assert model.depth == depth


def boosted_by_hand(x, y, w, classes, depth, rounds):
    margins = np.zeros((len(y), classes))
    onehot = np.eye(classes)[y]
    for _ in range(rounds):
        p = trees.softmax(margins)
        g, h = w[:, None] * (p - onehot), w[:, None] * np.maximum(p * (1 - p), 1e-12)
        worth = lambda rows: (g[rows].sum(0) ** 2 / (h[rows].sum(0) + 1)).sum()

        def grow(rows, left):
            best = (1e-9, None)
            for f in range(x.shape[1]) if left else []:
                for cut in np.unique(x[rows, f])[:-1]:
                    go = x[rows, f] <= cut
                    gain = worth(rows[go]) + worth(rows[~go]) - worth(rows)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
            if best[1] is None:
                return [(rows, -0.3 * g[rows].sum(0) / (h[rows].sum(0) + 1))]
            f, cut = best[1]
            go = x[rows, f] <= cut
            return grow(rows[go], left - 1) + grow(rows[~go], left - 1)

        for rows, value in grow(np.arange(len(y)), depth):
            margins[rows] += value
    return trees.softmax(margins)


def test_boosting_of_many_classes_by_hand(spark):
    rows = drawn(8, 200, 3, 4)
    df, names = table(spark, rows, 3)
    model = train.fit_node(df, "boosted", "label", names, 2, iterations=3)
    x, y = np.array([r[3:] for r in rows]), np.array([int(r[2][1:]) for r in rows])
    wanted = boosted_by_hand(x, y, (len(y) / (4 * np.bincount(y)))[y], 4, 2, 3)
    found = {r["id"]: r["p"] for r in model.transform(df).collect()}
    assert np.allclose([found[i] for i in range(200)], wanted, atol=1e-9)


def test_depth_beyond_thirty(spark):
    """A class for each value, in an order that only a chain of cuts can part."""
    rows = [(i, "N0", f"C{v:02d}", float(2 ** v if v < 1000 else 0)) for i, v in enumerate(list(range(40)) * 2)]
    df, names = table(spark, rows, 1)
    grown = train.fit_node(df, "tree", "label", names, 51)
    right = grown.transform(df).where("predicted = label").count()
    assert right == 80
    tree = trees.Tree()
    at = 0
    for step in range(45):
        tree.split(at, 0, 44 - step, [np.zeros(2), np.ones(2)])
        at = tree.left[at]
    assert max(tree.depth) == 45 and trees.walk(tree.arrays(), np.array([[0]], np.uint8)).tolist() == [at]


def test_nodes_together_as_one_by_one(spark):
    """Each node's model is what it is alone, and the passes do not grow with the nodes."""
    rows = drawn(5, 600, 3, 3, nodes=12)
    df, names = table(spark, rows, 3)
    df = df.withColumn("fold", (F.col("id") % 5 % 2).cast("int"))
    classes = {f"N{i}": ["C0", "C1", "C2"] for i in range(12)}
    few = {n: c for n, c in classes.items() if n in ("N0", "N7")}

    def jobs(group, what):
        spark.sparkContext.setJobGroup(group, group)
        found = what()
        spark.sparkContext._jsc.clearJobGroup()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    fit = lambda own: trees.fit_trees(df.where(F.col("_node").isin(*own)), "tree", "label", names, [1, 3], own, k=2)
    everything, many = jobs("twelve", lambda: fit(classes))
    two, less = jobs("two", lambda: fit(few))
    assert many <= less + 2
    for n in few:
        assert everything[n][0].rows == two[n][0].rows and everything[n][1] == two[n][1]
    scored = trees.score_nodes(df.where("_node in ('N0', 'N7') or id = 1"), {n: m for n, (m, _) in two.items()}, F.col("_node"))
    for n in few:
        alone = {r["id"]: r["p"] for r in two[n][0].transform(df.where(F.col("_node") == n)).collect()}
        assert {r["id"]: r["p"] for r in scored.where(F.col("_node") == n).collect()} == alone
    assert scored.where("id = 1").first()["p"] is None  # a node without a model


def test_folds_are_left_out(spark):
    """A label that only single rows of each fold explain: no model has seen the rows it is scored on."""
    rows = [(i, "N0", f"C{i % 2}", float(i)) for i in range(40)]
    df, names = table(spark, rows, 1)
    df = df.withColumn("fold", (F.col("id") % 4 / 2).cast("int"))
    (_, scores), = trees.fit_trees(df, "tree", "label", names, [1, 12], {"N0": ["C0", "C1"]}, k=2).values()
    model = train.fit_node(df, "tree", "label", names, 40)
    assert model.transform(df).where("predicted = label").count() == 40
    assert len(scores) == 2 and max(scores) < 0.8


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_saved_rows_give_the_same(spark, tmp_path, kind):
    df, names = table(spark, drawn(2, 120, 3, 3), 3)
    options = {"iterations": 2} if kind == "boosted" else {"trees": 4}
    model = train.fit_node(df, kind, "label", names, 2, **options)
    model.save(spark, str(tmp_path), "A Node", "genus")
    again = train.NodeModel.load(spark, str(tmp_path), "A Node", kind, "genus")
    a, b = (sorted(map(str, m.transform(df).select("id", "p", "predicted").collect())) for m in (model, again))
    assert a == b and again.features == names
    accuracy = balanced_accuracy(pair_counts(model.transform(df), "label", "predicted")).first()[0]
    assert accuracy > 0.6
