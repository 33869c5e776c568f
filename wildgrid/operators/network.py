"""Networks with ReLU layers, trained by Adam on class-weighted mini-batches, many models in the same steps.

Rows are dealt to mini-batches by a hash and written by batch. A step reads the
files of one batch only: tasks add up the gradients of their rows for every
model, and the sums move the weights. All nodes of a level, all training sets
of the folds (everything but one fold, and everything) and all learning rates
take their steps together, so the number of jobs is epochs times batches,
whatever the number of models. Sizes of layers bound what a step sends: one sum
for each weight. Models beyond ``HELD_BYTES`` of weights are trained in turns.
"""

import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.registry import artefact_name, register
from .storage import forget, settle
from .trees import TASK_ROWS, class_weights, mean_scores, numbered_rows, score_nodes, softmax

# Widths of the layers between the first, which is as wide as the features, and the classes.
HIDDEN = (80, 60)
EPOCHS, BATCHES = 10, 16
# Weights of the models that take their steps together.
HELD_BYTES = 64 << 20
# Up to this many tasks send their sums to the driver; more are added up by a shuffle first.
DIRECT, BLOCK = 16, 4096
MEAN_DECAY, SQUARE_DECAY, TINY = 0.9, 0.999, 1e-7

#: One model in training: rows of ``node`` outside the fold ``without`` (-1: all rows), one learning rate.
Spec = namedtuple("Spec", "node without rate sizes mean deviation weights")


def layers(flat, sizes):
    """(weights, bias) of each layer as views of one vector."""
    at = 0
    for width, out in zip(sizes, sizes[1:]):
        yield flat[at:at + width * out].reshape(width, out), flat[at + width * out:at + width * out + out]
        at += (width + 1) * out


def n_weights(sizes):
    return sum((width + 1) * out for width, out in zip(sizes, sizes[1:]))


def first_weights(sizes, seed):
    """Uniform weights by the widths on both sides of a layer; no bias."""
    random, flat = np.random.default_rng(seed), np.zeros(n_weights(sizes))
    for weights, _ in layers(flat, sizes):
        limit = np.sqrt(6 / sum(weights.shape))
        weights[:] = random.uniform(-limit, limit, weights.shape)
    return flat


def outputs(flat, sizes, x):
    """The values of all layers, the input first and the class probabilities last."""
    values = [x]
    for number, (weights, bias) in enumerate(layers(flat, sizes)):
        z = values[-1] @ weights + bias
        values.append(softmax(z) if number == len(sizes) - 2 else np.maximum(z, 0))
    return values


def gradient(flat, sizes, x, label, weight):
    """Sum over the rows of the gradient of the weighted cross entropy."""
    values, out = outputs(flat, sizes, x), np.zeros_like(flat)
    slope = values[-1].copy()
    slope[np.arange(len(x)), label] -= 1
    slope *= weight[:, None]
    both = list(zip(layers(flat, sizes), layers(out, sizes)))
    for number in range(len(both) - 1, -1, -1):
        (weights, _), (into, into_bias) = both[number]
        into += values[number].T @ slope
        into_bias += slope.sum(axis=0)
        slope = (slope @ weights.T) * (values[number] > 0)
    return out


class Adam:
    """Moments of the gradients of one model."""

    def __init__(self, size, rate):
        self.rate, self.steps, self.mean, self.square = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, flat, slope):
        self.steps += 1
        self.mean += (1 - MEAN_DECAY) * (slope - self.mean)
        self.square += (1 - SQUARE_DECAY) * (slope ** 2 - self.square)
        rate = self.rate * np.sqrt(1 - SQUARE_DECAY ** self.steps) / (1 - MEAN_DECAY ** self.steps)
        flat -= rate * self.mean / (np.sqrt(self.square) + TINY)


def _moments(numbered, width):
    """{(node, fold): (n, means, variances)} of the features."""
    stats = [f(f"f{i}") for f in (F.avg, F.var_pop) for i in range(width)]
    rows = numbered.groupBy("node", "fold").agg(F.count(F.lit(1)).alias("n"), F.array(*stats).alias("s")).collect()
    return {(r["node"], r["fold"]): (r["n"], np.array(r["s"][:width]), np.array(r["s"][width:])) for r in rows}


def _scale(moments, node, without):
    """Mean and deviation of a training set from those of its folds; a constant is divided by one."""
    parts = [m for (one, fold), m in moments.items() if one == node and fold != without]
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0, 1.0
    mean = sum(p[0] * p[1] for p in parts) / n
    deviation = np.sqrt(sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n)
    return mean, np.where(deviation > 0, deviation, 1.0)


def _matrix(batch):
    x = batch.column("x")
    return np.asarray(x.flatten()).reshape(batch.num_rows, -1)


def _sums(rows, specs, flats):
    """(spec, block, sums) of the gradients of each task's rows; block -1 holds the sum of the weights."""
    def run(batches):
        sums, total = {}, {}
        weights = flats.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            node, fold, label = (batch.column(c).to_numpy() for c in ("node", "fold", "label"))
            for m, spec in enumerate(specs):
                own = np.flatnonzero((node == spec.node) & (fold != spec.without))
                if not len(own):
                    continue
                weight = spec.weights[label[own]]
                part = gradient(weights[m], spec.sizes, (x[own] - spec.mean) / spec.deviation, label[own], weight)
                sums[m] = sums[m] + part if m in sums else part
                total[m] = total.get(m, 0.0) + weight.sum()
        for m, whole in sums.items():
            blocks = [np.array([total[m]]), *np.split(whole, range(BLOCK, len(whole), BLOCK))]
            yield _block_rows([(m, b - 1, block) for b, block in enumerate(blocks)])

    return rows.mapInArrow(run, BLOCKS)


BLOCKS = "spec int, block int, sums array<double>"


def _block_rows(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["spec", "block", "sums"])


def _added(sums, parts):
    """The sums of all tasks: each partition holds one sum for each of its blocks."""
    def run(batches):
        whole = {}
        for batch in batches:
            values = batch.column("sums")
            for i, at in enumerate(zip(batch.column("spec").to_pylist(), batch.column("block").to_pylist())):
                own = np.asarray(values[i].values)
                whole[at] = whole[at] + own if at in whole else own
        for at, own in whole.items():
            yield _block_rows([(*at, own)])

    return sums.repartition(parts, "spec", "block").mapInArrow(run, BLOCKS)


def _train(coded, tasks, specs, epochs, batches, seed):
    """The weights of all models after all steps."""
    flats = [first_weights(s.sizes, [seed, zlib.crc32(str(s.sizes).encode())]) for s in specs]
    ways = [Adam(len(w), s.rate) for w, s in zip(flats, specs)]
    rows = coded.where(F.col("node").isin(*sorted({s.node for s in specs})))
    for step in range(epochs * batches):
        held = coded.sparkSession.sparkContext.broadcast(flats)
        sums = _sums(rows.where(F.col("batch") == step % batches), specs, held)
        if tasks > DIRECT:
            sums = _added(sums, min(tasks, 1 + sum(len(w) for w in flats) // BLOCK))
        slopes = [np.zeros_like(w) for w in flats]
        total = [0.0] * len(flats)
        for r in sums.toLocalIterator() if tasks > DIRECT else sums.collect():
            if r["block"] < 0:
                total[r["spec"]] += r["sums"][0]
            else:
                slopes[r["spec"]][r["block"] * BLOCK:][:len(r["sums"])] += r["sums"]
        for m, flat in enumerate(flats):
            if total[m] > 0:
                ways[m].step(flat, slopes[m] / total[m])
        held.destroy()
    return flats


def _votes(coded, specs, flats, rates):
    """(node, value, fold, truth, guess, n) of rows by the models that have not seen their fold."""
    held = coded.sparkSession.sparkContext.broadcast(flats)

    def run(batches):
        counts = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            node, fold, label = (batch.column(c).to_numpy() for c in ("node", "fold", "label"))
            for spec, flat in zip(specs, held.value):
                own = np.flatnonzero((node == spec.node) & (fold == spec.without))
                if not len(own):
                    continue
                guess = outputs(flat, spec.sizes, (x[own] - spec.mean) / spec.deviation)[-1].argmax(axis=1)
                for pair, times in zip(*np.unique(np.stack([label[own], guess], axis=1), axis=0, return_counts=True)):
                    at = (spec.node, rates.index(spec.rate), spec.without, int(pair[0]), int(pair[1]))
                    counts[at] = counts.get(at, 0) + int(times)
        columns = list(zip(*[(*at, n) for at, n in counts.items()])) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["node", "value", "fold", "truth", "guess", "n"])

    return coded.mapInArrow(run, "node long, value long, fold long, truth long, guess long, n long").groupBy(
        "node", "value", "fold", "truth", "guess").agg(F.sum("n").alias("n"))


def _turns(specs):
    """Models in groups whose weights stay below ``HELD_BYTES``; a larger one is alone."""
    turn, size = [], 0
    for spec in specs:
        own = 8 * n_weights(spec.sizes)
        if turn and size + own > HELD_BYTES:
            yield turn
            turn, size = [], 0
        turn.append(spec)
        size += own
    if turn:
        yield turn


def fit_networks(rows, target, features, grid, classes, node="_node", key="id", k=0, seed=0, balance=True,
                 epochs=EPOCHS, batches=BATCHES, hidden=HIDDEN):
    """{node: (NetworkModel, mean scores of the grid)}: one model for each node, all of them together.

    Takes and returns what ``fit_trees`` does; the grid has learning rates.
    Features are standardised by the training set. A batch of which a model has
    no row moves nothing.
    """
    numbered, counts, nodes, _ = numbered_rows(rows, target, features, classes, node, key, k, seed)
    moments = _moments(numbered, len(features))
    tasks = max(1, -(-sum(counts.values()) // (TASK_ROWS * batches)))
    coded = settle(numbered.select(
        "node", "fold", "label", F.array(*[f"f{i}" for i in range(len(features))]).alias("x"),
        F.pmod(F.xxhash64("draw"), F.lit(batches)).cast("int").alias("batch")).repartition(tasks),
        "coded", partition_by=["batch"])
    forget(numbered)
    rates, specs = [float(v) for v in grid], []
    present = sorted({n for n, _, _ in counts})
    for n in present:
        sizes = (len(features), len(features), *hidden, len(classes[nodes[n]]))
        for without in [*range(k), -1]:
            scale = _scale(moments, n, without)
            weights = class_weights(counts, n, without, sizes[-1], balance)
            specs += [Spec(n, without, rate, sizes, *scale, weights) for rate in dict.fromkeys(rates)]
    trained, scores = {}, {n: [0.0] * len(grid) for n in present}
    for turn in _turns(specs):
        flats = _train(coded, tasks, turn, epochs, batches, seed)
        trained.update({(s.node, s.without, s.rate): (s, w) for s, w in zip(turn, flats)})
    if k:
        votes = []
        for turn in _turns([s for s in specs if s.without >= 0]):
            flats = [trained[s.node, s.without, s.rate][1] for s in turn]
            votes += _votes(coded, turn, flats, rates).collect()  # pairs of classes of each model
        scores = mean_scores(votes, present, rates, k)
    forget(coded)
    out = {}
    for n in present:
        spec, flat = trained[n, -1, rates[int(np.argmax(scores[n]))]]
        out[nodes[n]] = (NetworkModel(flat, spec.sizes, spec.mean, spec.deviation, features, classes[nodes[n]], target),
                         scores[n])
    return out


class NetworkModel:
    """A trained network: one vector of weights and the scale of the features."""

    kind = "network"

    def __init__(self, flat, sizes, mean, deviation, features, classes, target):
        self.flat, self.sizes = np.asarray(flat, float), tuple(sizes)
        self.mean, self.deviation = (np.broadcast_to(np.asarray(x, float), len(features)) for x in (mean, deviation))
        self.features, self.classes, self.target = list(features), list(classes), target

    def scorer(self):
        """A function from a matrix of features to class probabilities."""
        return lambda matrix: outputs(self.flat, self.sizes, (matrix - self.mean) / self.deviation)[-1]

    def transform(self, df):
        """Add ``classes``, ``p`` (probabilities in class order) and ``predicted``."""
        kept = [f"`{c}`" for c in df.columns if c not in ("classes", "p", "predicted")]
        return score_nodes(df.select(*kept), {"": self}, F.lit(""))

    def save(self, spark, root, node, level=""):
        """Write the model as one row of a table and register it."""
        path = f"{root}/models/{artefact_name(node, self.kind, level)}"
        row = [(self.flat.tolist(), list(self.sizes), self.mean.tolist(), self.deviation.tolist())]
        spark.createDataFrame(row, "weights array<double>, sizes array<int>, mean array<double>, deviation array<double>") \
            .select("*", F.array(*map(F.lit, self.features)).alias("features"),
                    F.array(*map(F.lit, self.classes)).alias("classes"), F.lit(self.target).alias("target")) \
            .coalesce(1).write.mode("overwrite").parquet(path)
        return register(spark, root, node, self.kind, level, path)

    @classmethod
    def load(cls, spark, root, node, level=""):
        return cls(*spark.read.parquet(f"{root}/models/{artefact_name(node, cls.kind, level)}").first())
