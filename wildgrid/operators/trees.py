"""Decision trees, forests and boosted trees grown from histograms, many models in the same passes.

Features are cut into bins once for each node of the hierarchy. A pass over the
rows adds up, for every model and every open leaf, the statistics of each
(feature, bin); the best cut of a leaf follows from these sums. One pass opens
a level of all models at once: of all nodes, of all training sets of the folds
(everything but one fold, and everything), of all trees of a forest, and of all
depths that boosting tries. So the number of jobs follows the depth of the
trees and the rounds of boosting, not the number of nodes, folds or values. A
tree of depth d is the top of a deeper one, so a grid of depths is one tree.

Leaves are named by their place in the tree's list, so no depth is too large.
All classes share a tree: a leaf holds one number for each class. The driver
keeps the trees and one row for each open leaf; sums stay on the workers.
"""

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..functions import vectors
from ..sources.registry import artefact_name, register
from .storage import forget, settle

KINDS = ("tree", "forest", "boosted")
BINS = 64
# Boosting: step of a round, penalty of large leaf values, rounds.
RATE, PENALTY, ROUNDS = 0.3, 1.0, 20
TASK_ROWS = 50_000
# Sums that a worker holds before it hands them on, and that one group of them may need.
HELD_BYTES = 64 << 20

#: One model in growth: rows of ``node`` outside the fold ``without`` (-1: all rows).
Spec = namedtuple("Spec", "node without depth tree")
CODED = "node int, fold int, label int, draw long, bins binary, margins binary"


class Tree:
    """A tree as lists over its places; ``left`` is -1 at a leaf and ``bin`` goes left."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.depth, self.value = [0], [0], [-1], [-1], [0], [None]

    def split(self, place, feature, cut, values):
        """Open a leaf; its children get the next two places."""
        self.feature[place], self.bin[place], self.left[place], self.right[place] = feature, cut, *self._add(place, values)

    def _add(self, place, values):
        for value in values:
            for part, x in zip((self.feature, self.bin, self.left, self.right, self.depth, self.value),
                               (0, 0, -1, -1, self.depth[place] + 1, value)):
                part.append(x)
        return len(self.left) - 2, len(self.left) - 1

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.right, self.depth))


def walk(arrays, codes, depth=None):
    """Place of every row, at most ``depth`` steps below the root."""
    feature, cut, left, right, _ = arrays
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    step = 0
    while len(rows) and (depth is None or step < depth):
        rows = rows[left[at[rows]] >= 0]
        here = at[rows]
        goes_left = codes[rows, feature[here]] <= cut[here]
        at[rows] = np.where(goes_left, left[here], right[here])
        step += 1
    return at


def _edges(rows, width):
    """{node: thresholds of each feature}: midpoints between neighbouring quantiles of the node's rows."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(BINS)])
    found = rows.groupBy("node").agg(*[F.percentile_approx(f"f{i}", shares, 100 * BINS).alias(f"q{i}") for i in range(width)])
    edges = {}
    for r in found.collect():  # as many rows as nodes
        quantiles = [np.unique(np.array(r[f"q{i}"], float)) for i in range(width)]
        edges[r["node"]] = [q[:-1] + (q[1:] - q[:-1]) / 2 for q in quantiles]
    return edges


def _coded(rows, width, edges):
    """Rows with the bin of every feature, and no margins yet."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = batch.column(0).to_numpy()
            codes = np.empty((n, width), np.uint8)
            columns = [batch.column(4 + i).to_numpy() for i in range(width)]
            for one in np.unique(node):
                own = node == one
                for i, values in enumerate(columns):
                    codes[own, i] = np.searchsorted(edges[one][i], values[own], side="left")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([b""] * n, pa.binary())], names=[c.split()[0] for c in CODED.split(", ")])

    return rows.select("node", "fold", "label", "draw", *[f"f{i}" for i in range(width)]).mapInArrow(run, CODED)


def _matrix(column, dtype, n):
    """A binary column whose entries have equal length, as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


def _often(draw, tree):
    """How often a row is drawn into the sample of a tree: Poisson with mean 1, from its hash."""
    mixed = draw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    unit = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    steps, chance = [], np.exp(-1.0)
    for k in range(1, 9):
        steps.append(chance if k == 1 else steps[-1] + chance)
        chance /= k
    return np.searchsorted(steps, unit, side="right")


class Growth:
    """What the workers need to know of the models in one pass."""

    def __init__(self, specs, trees, weights, classes, edges, kind, seed):
        self.specs, self.weights, self.classes, self.edges, self.kind, self.seed = specs, weights, classes, edges, kind, seed
        self.width = len(next(iter(edges.values())))
        self.trees = {m: t.arrays() for m, t in trees.items()}
        self.of_node, self.slot = {}, {}
        for m, spec in enumerate(specs):
            self.slot[m] = len(self.of_node.setdefault(spec.node, []))
            self.of_node[spec.node].append(m)
        self.stats = classes if kind != "boosted" else 2 * classes + 1

    def batches(self, batch):
        """(model, rows of the batch in its training set, their weights) for every model."""
        node, fold, label = (batch.column(i).to_numpy() for i in range(3))
        draw = batch.column(3).to_numpy()
        for one in np.unique(node):
            own = node == one
            for m in self.of_node.get(int(one), ()):
                rows = np.flatnonzero(own & (fold != self.specs[m].without))
                weight = self.weights[m][label[rows]]
                if self.kind == "forest":
                    weight = weight * _often(draw[rows], self.specs[m].tree)
                yield m, rows, weight

    def margins(self, batch):
        """Margins of all models of the rows' nodes: rows x models x classes, zeros before the first round."""
        n, most = batch.num_rows, max(map(len, self.of_node.values()))
        if len(batch.column(5)[0].as_py()) == 0:
            return np.zeros((n, most, self.classes))
        return _matrix(batch.column(5), np.float64, n).reshape(n, most, self.classes)

    def statistics(self, m, rows, weight, label, margins):
        """Per row what a leaf adds up: class weights, or gradients, curvatures and the weight."""
        if self.kind != "boosted":
            out = np.zeros((len(rows), self.classes))
            out[np.arange(len(rows)), label[rows]] = weight
            return out
        p = softmax(margins[rows, self.slot[m]])
        y = np.zeros_like(p)
        y[np.arange(len(rows)), label[rows]] = 1
        w = weight[:, None]
        return np.hstack([w * (p - y), w * np.maximum(p * (1 - p), 1e-12), w])


def softmax(margins):
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


SUMS = "model int, leaf int, block int, cells binary, sums binary"


def _sums(coded, growth, open_leaves, blocks):
    """Partial sums of every (model, open leaf, block of features): the cells that are not zero."""
    per_block = -(-growth.width // blocks)
    size = growth.width * BINS

    def run(batches):
        held, used = {}, 0

        def rows():
            columns = [[], [], [], [], []]
            for (m, leaf), table in held.items():
                for b in range(blocks):
                    part = table[b * per_block * BINS:(b + 1) * per_block * BINS]
                    cells = np.flatnonzero(np.any(part, axis=1))
                    for c, x in zip(columns, (m, leaf, b, cells.astype(np.int32).tobytes(), part[cells].tobytes())):
                        c.append(x)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=[c.split()[0] for c in SUMS.split(", ")])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, label = _matrix(batch.column(4), np.uint8, n), batch.column(2).to_numpy()
            margins = growth.margins(batch) if growth.kind == "boosted" else None
            for m, chosen, weight in growth.batches(batch):
                wanted = open_leaves.get(m)
                if not wanted or not len(chosen):
                    continue
                place = walk(growth.trees[m], codes[chosen])
                stats = growth.statistics(m, chosen, weight, label, margins)
                for leaf in wanted:
                    own = np.flatnonzero((place == leaf) & (weight > 0))
                    if not len(own):
                        continue
                    table = held.get((m, leaf))
                    if table is None:
                        table = held[m, leaf] = np.zeros((size, growth.stats))
                        used += table.nbytes
                    cell = (codes[chosen[own]] + np.arange(growth.width) * BINS).ravel()
                    for s in range(growth.stats):
                        part = stats[own, s]
                        if part.any():
                            table[:, s] += np.bincount(cell, np.repeat(part, growth.width), size)
                    if used > HELD_BYTES:
                        yield rows()
                        used = 0
        yield rows()

    return coded.mapInArrow(run, SUMS)


BEST = "model int, leaf int, gain double, feature int, cut int, left array<double>, right array<double>"


def _worth(sums, kind, classes):
    """Value of a leaf: purity of its classes, or the drop of the loss."""
    if kind != "boosted":
        return (sums ** 2).sum(axis=-1) / np.maximum(sums.sum(axis=-1), 1e-300)
    return (sums[..., :classes] ** 2 / (sums[..., classes:2 * classes] + PENALTY)).sum(axis=-1)


def _best_cuts(partial, growth, blocks):
    """The best cut of each block of features of each open leaf."""
    per_block = -(-growth.width // blocks)

    def run(key, table):
        m, leaf, block = (k.as_py() for k in key)
        features = min(per_block, growth.width - block * per_block)
        sums = np.zeros((features * BINS, growth.stats))
        for cells, values in zip(table.column("cells").to_pylist(), table.column("sums").to_pylist()):
            sums[np.frombuffer(cells, np.int32)] += np.frombuffer(values).reshape(-1, growth.stats)
        sums = sums.reshape(features, BINS, growth.stats)
        left = np.cumsum(sums, axis=1)
        whole = left[:, -1:, :]
        right = whole - left
        amount = (lambda x: x.sum(axis=-1)) if growth.kind != "boosted" else (lambda x: x[..., -1])
        gain = _worth(left, growth.kind, growth.classes) + _worth(right, growth.kind, growth.classes) - \
            _worth(whole, growth.kind, growth.classes)
        least = 1e-9 * amount(whole)
        gain[(amount(left) <= least) | (amount(right) <= least)] = -np.inf
        if growth.kind == "forest":  # a few features for each leaf, drawn by its place
            drawn = np.random.default_rng([growth.seed, growth.specs[m].tree, leaf])
            few = drawn.permutation(growth.width)[:max(1, int(round(growth.width ** 0.5)))]
            gain[~np.isin(np.arange(features) + block * per_block, few)] = -np.inf
        # Sums differ in their last digits by the order of tasks: equal gains go to the first
        # feature. Of its equal cuts, which part the rows alike, the one with most room around it is taken.
        top, f, cut = gain.max(), 0, 0
        if np.isfinite(top):
            f = int(np.flatnonzero(gain.max(axis=1) >= top - 1e-9 * abs(top))[0])
            equal = np.flatnonzero(gain[f] >= top - 1e-9 * abs(top))
            gaps = np.diff(growth.edges[growth.specs[m].node][f + block * per_block])
            room = np.minimum(np.append(gaps[:1], gaps), np.append(gaps, gaps[-1:])) if len(gaps) else np.zeros(1)
            cut = int(equal[np.argmax(room[equal])])
        return pa.table({"model": pa.array([m], pa.int32()), "leaf": pa.array([leaf], pa.int32()),
                         "gain": pa.array([float(top)]), "feature": pa.array([f + block * per_block], pa.int32()),
                         "cut": pa.array([cut], pa.int32()), "left": pa.array([left[f, cut].tolist()], pa.list_(pa.float64())),
                         "right": pa.array([right[f, cut].tolist()], pa.list_(pa.float64()))})

    found = partial.groupBy("model", "leaf", "block").applyInArrow(run, BEST)
    if blocks == 1:
        return found
    order = F.struct(F.round("gain", 9), -F.col("feature"))
    return found.groupBy("model", "leaf").agg(F.max_by(F.struct(*found.columns[2:]), order).alias("b")).select(
        "model", "leaf", "b.*")


def _leaf_value(sums, kind, classes):
    sums = np.asarray(sums)
    if kind != "boosted":
        return sums / max(sums.sum(), 1e-300)
    return -RATE * sums[:classes] / (sums[classes:2 * classes] + PENALTY)


def _grow(coded, tasks, specs, weights, classes, edges, kind, seed):
    """One tree for each model, level by level."""
    trees = {m: Tree() for m in range(len(specs))}
    open_leaves = {m: [0] for m in trees}
    while open_leaves:
        growth = Growth(specs, trees, weights, classes, edges, kind, seed)
        blocks = min(growth.width, max(1, tasks * growth.width * BINS * growth.stats * 8 // HELD_BYTES))
        best = _best_cuts(_sums(coded, growth, open_leaves, blocks), growth, blocks)
        following = {}
        for r in best.collect():  # one row for each open leaf
            tree, place = trees[r["model"]], r["leaf"]
            left, right = np.array(r["left"]), np.array(r["right"])
            value = _leaf_value(left + right, kind, classes)
            tree.value[place] = value
            amount = (left + right).sum() if kind != "boosted" else 1.0
            if r["gain"] <= 1e-9 * max(1e-300, amount) or not np.isfinite(r["gain"]):
                continue
            tree.split(place, r["feature"], r["cut"], [_leaf_value(x, kind, classes) for x in (left, right)])
            limit = specs[r["model"]].depth
            if limit is None or tree.depth[place] + 1 < limit:
                following.setdefault(r["model"], []).extend([tree.left[place], tree.right[place]])
        open_leaves = following
    for tree in trees.values():
        tree.value = [np.full(classes, 1 / classes if kind != "boosted" else 0.0) if v is None else v for v in tree.value]
    return trees


def _with_margins(coded, growth, trees):
    """The rows with the leaf values of the round's trees added to their margins."""
    values = {m: np.array(t.value) for m, t in trees.items()}

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, node = _matrix(batch.column(4), np.uint8, n), batch.column(0).to_numpy()
            margins = growth.margins(batch).copy()
            for one in np.unique(node):
                rows = np.flatnonzero(node == one)
                for m in growth.of_node[int(one)]:
                    margins[rows, growth.slot[m]] += values[m][walk(growth.trees[m], codes[rows])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(
                [x.tobytes() for x in margins], pa.binary())], names=batch.schema.names)

    return coded.mapInArrow(run, CODED)


def _probabilities(forest, kind, codes, depth=None):
    """Class probabilities of coded rows by the trees of one model."""
    total = sum(np.array(t.value)[walk(t.arrays(), codes, depth)] for t in forest)
    return softmax(total) if kind == "boosted" else total / len(forest)


def _votes(coded, forests, kind, grid):
    """(node, value, fold, truth, guess, n) of rows by the models that have not seen their fold."""
    def run(batches):
        counts = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = _matrix(batch.column(4), np.uint8, n)
            node, fold, label = (batch.column(i).to_numpy() for i in range(3))
            for one, f in {*zip(node.tolist(), fold.tolist())}:
                own = np.flatnonzero((node == one) & (fold == f))
                for v, value in enumerate(grid):
                    forest = forests[one, f, value if kind == "boosted" else None]
                    guess = _probabilities(forest, kind, codes[own], None if kind == "boosted" else value).argmax(axis=1)
                    for pair, times in zip(*np.unique(np.stack([label[own], guess], axis=1), axis=0, return_counts=True)):
                        key = (one, v, f, int(pair[0]), int(pair[1]))
                        counts[key] = counts.get(key, 0) + int(times)
        columns = list(zip(*[(*k, c) for k, c in counts.items()])) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["node", "value", "fold", "truth", "guess", "n"])

    return coded.mapInArrow(run, "node long, value long, fold long, truth long, guess long, n long").groupBy(
        "node", "value", "fold", "truth", "guess").agg(F.sum("n").alias("n"))


def mean_scores(votes, nodes, grid, k):
    """{node: mean balanced accuracy over the folds for each value}."""
    right, whole = {}, {}
    for r in votes:  # nodes x values x folds x pairs of classes
        at = (r["node"], r["value"], r["fold"], r["truth"])
        whole[at] = whole.get(at, 0) + r["n"]
        right[at] = right.get(at, 0) + (r["n"] if r["truth"] == r["guess"] else 0)
    recalls = {}
    for at, n in whole.items():
        recalls.setdefault(at[:3], []).append(right[at] / n)
    means = {key: sum(x) / len(x) for key, x in recalls.items()}
    return {node: [sum(means.get((node, v, f), 0.0) for f in range(k)) / k for v in range(len(grid))] for node in nodes}


def class_weights(counts, node, without, classes, balance):
    """Weight of each class in a training set: all rows of the node less one fold."""
    sizes = np.zeros(classes)
    for (one, fold, label), n in counts.items():
        if one == node and fold != without:
            sizes[label] += n
    if not balance:
        return np.ones(classes)
    present = max(1, int((sizes > 0).sum()))
    return np.divide(sizes.sum(), present * sizes, out=np.zeros(classes), where=sizes > 0)


def numbered_rows(rows, target, features, classes, node, key, k, seed):
    """Rows as (node, label, fold, draw, f0, f1, ..) by number, their counts, the nodes and the most classes of one."""
    spark = rows.sparkSession
    nodes = sorted(classes)
    number = {n: i for i, n in enumerate(nodes)}
    most = max(len(c) for c in classes.values())
    names = settle(spark.createDataFrame([(n, c, number[n], i) for n in nodes for i, c in enumerate(classes[n])],
                                         T.StructType([T.StructField("_n", T.StringType()),
                                                       T.StructField("_c", rows.schema[target].dataType),
                                                       T.StructField("node", T.IntegerType()),
                                                       T.StructField("label", T.IntegerType())])).coalesce(1), "classes")
    fold = F.col("fold") if k else F.lit(0)
    plain = rows.select(F.col(node).cast("string").alias("_at"), F.col(f"`{target}`").alias("_t"), fold.cast("int").alias("fold"),
                        F.xxhash64(key, F.lit(seed)).alias("draw"),
                        *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    numbered = settle(plain.join(names, (F.col("_at") == F.col("_n")) & (F.col("_t") == F.col("_c")))
                      .drop("_at", "_t", "_n", "_c"), "numbered")
    counts = {(r["node"], r["fold"], r["label"]): r["count"]
              for r in numbered.groupBy("node", "fold", "label").count().collect()}
    return numbered, counts, nodes, most


def fit_trees(rows, kind, target, features, grid, classes, node="_node", key="id", k=0, seed=0, balance=True,
              trees=100, iterations=None):
    """{node: (TreeModel, mean scores of the grid)}: one model for each node, all of them together.

    ``rows`` has the node, the key, the target, all features without nulls and,
    with ``k`` folds, a column ``fold``; ``classes`` maps each node to its class
    names. The value of the grid with the best mean score, the first of equals,
    is taken; without folds there are no scores, and the first value is taken.
    The model of all rows grows in the same passes as those of the folds.
    """
    numbered, counts, nodes, most = numbered_rows(rows, target, features, classes, node, key, k, seed)
    edges = _edges(numbered, len(features))
    tasks = max(1, -(-sum(counts.values()) // TASK_ROWS))
    coded = settle(_coded(numbered, len(features), edges).repartition(tasks), "coded")
    forget(numbered)

    present = sorted({n for n, _, _ in counts})
    each = range(trees) if kind == "forest" else [0]
    depths = [int(v) for v in grid] if kind == "boosted" else [max(int(v) for v in grid)]
    specs = [Spec(n, without, depth, t) for n in present for without in [*range(k), -1] for depth in depths for t in each]
    weights = [class_weights(counts, s.node, s.without, most, balance) for s in specs]
    forests = {}
    for number_of_round in range((iterations or ROUNDS) if kind == "boosted" else 1):
        grown = _grow(coded, tasks, specs, weights, most, edges, kind, seed)
        for m, spec in enumerate(specs):
            at = (spec.node, spec.without, spec.depth if kind == "boosted" else None)
            forests.setdefault(at, []).append(grown[m])
        if kind == "boosted":
            growth = Growth(specs, grown, weights, most, edges, kind, seed)
            following = settle(_with_margins(coded, growth, grown), "coded")
            forget(coded)
            coded = following
    scores = {n: [0.0] * len(grid) for n in present}
    if k:
        scores = mean_scores(_votes(coded, forests, kind, [int(v) for v in grid]).collect(), present, grid, k)
    forget(coded)
    out = {}
    for n in present:
        best = int(np.argmax(scores[n]))
        value = int(grid[best])
        forest = forests[n, -1, value if kind == "boosted" else None]
        out[nodes[n]] = (TreeModel.of(forest, edges[n], kind, features, classes[nodes[n]], target,
                                      None if kind == "boosted" else value), scores[n])
    return out


ROWS = ("tree int, place int, feature int, threshold double, left int, right int, value array<double>")


class TreeModel:
    """A fitted model as rows: one for each place of each tree."""

    def __init__(self, rows, kind, features, classes, target):
        self.rows, self.kind, self.features, self.classes, self.target = rows, kind, list(features), list(classes), target

    @classmethod
    def of(cls, forest, edges, kind, features, classes, target, depth=None):
        """Rows of grown trees, cut below ``depth``; thresholds in place of bins."""
        rows, wide = [], len(classes)
        for t, tree in enumerate(forest):
            for place, left in enumerate(tree.left):
                if depth is not None and tree.depth[place] > depth:
                    continue
                leaf = left < 0 or (depth is not None and tree.depth[place] == depth)
                f = tree.feature[place]
                rows.append((t, place, f, 0.0 if leaf else float(edges[f][tree.bin[place]]), -1 if leaf else left,
                             -1 if leaf else tree.right[place], [float(x) for x in tree.value[place][:wide]]))
        return cls(rows, kind, features, classes, target)

    @property
    def depth(self):
        """Steps from a root to the deepest leaf."""
        below = {}
        for t, place, _, _, left, right, _ in sorted(self.rows, key=lambda r: r[:2], reverse=True):
            below[t, place] = 0 if left < 0 else 1 + max(below[t, left], below[t, right])
        return max(below[t, 0] for t, *_ in self.rows)

    def scorer(self):
        """A function from a matrix of features to class probabilities."""
        trees = []
        for t in sorted({r[0] for r in self.rows}):
            own = sorted(r for r in self.rows if r[0] == t)
            at = {r[1]: i for i, r in enumerate(own)}
            trees.append(tuple(np.array(x) for x in (
                [r[2] for r in own], [r[3] for r in own], [at.get(r[4], -1) for r in own],
                [at.get(r[5], -1) for r in own], [0] * len(own))) + (np.array([r[6] for r in own]),))
        boosted = self.kind == "boosted"

        def score(matrix):
            total = sum(t[5][walk(t[:5], matrix)] for t in trees)
            return softmax(total) if boosted else total / len(trees)

        return score

    def transform(self, df):
        """Add ``classes``, ``p`` (probabilities in class order) and ``predicted``."""
        kept = [f"`{c}`" for c in df.columns if c not in ("classes", "p", "predicted")]
        return score_nodes(df.select(*kept), {"": self}, F.lit(""))

    def save(self, spark, root, node, level=""):
        """Write the rows, with what names them, and register the model."""
        path = f"{root}/models/{artefact_name(node, self.kind, level)}"
        spark.createDataFrame(self.rows, ROWS).select(
            "*", F.lit(self.kind).alias("kind"), F.lit(self.target).alias("target"),
            F.array(*map(F.lit, self.features)).alias("features"),
            F.array(*map(F.lit, self.classes)).alias("classes")).coalesce(1).write.mode("overwrite").parquet(path)
        return register(spark, root, node, self.kind, level, path)

    @classmethod
    def load(cls, spark, root, node, kind, level=""):
        found = spark.read.parquet(f"{root}/models/{artefact_name(node, kind, level)}").collect()
        first = found[0]
        return cls([tuple(r)[:7] for r in found], first["kind"], first["features"], first["classes"], first["target"])


def score_nodes(df, models, node):
    """Rows with ``classes``, ``p`` and ``predicted`` by the model of each row's node: one branch for all nodes.

    ``models`` maps node names to models of trees or networks, ``node`` is a column of names;
    rows of other nodes get nulls. Models may use different features.
    """
    names = list(dict.fromkeys(f for m in models.values() for f in m.features))
    # As large as the models, sent to each executor once.
    held = df.sparkSession.sparkContext.broadcast(dict(models))

    def probabilities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorers = {n: (m.scorer(), [names.index(f) for f in m.features]) for n, m in held.value.items()}
        for at, values in batches:
            out = np.empty(len(at), object)
            matrix = np.array([np.asarray(v, float) for v in values]).reshape(len(at), len(names))
            for n in at.dropna().unique():
                if n in scorers:
                    own = np.flatnonzero((at == n).to_numpy())
                    for i, p in zip(own, scorers[n][0](matrix[np.ix_(own, scorers[n][1])])):
                        out[i] = p.tolist()
            yield pd.Series(out)

    at = node.cast("string")
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in names])
    listed = F.coalesce(*[F.when(at == n, F.array(*map(F.lit, m.classes))) for n, m in models.items()])
    out = df.withColumn("classes", listed).withColumn("p", F.pandas_udf(probabilities, "array<double>")(at, values))
    return out.withColumn("predicted", vectors.pick("classes", "p")).select(*df.columns, "classes", "p", "predicted")
