"""Weighted k-means: every number of clusters and every restart in the same passes.

The first centres come from candidates that are drawn in a few passes, far
points first (k-means||); Lloyd steps follow. A pass reads the points once,
assigns each to the nearest centre of every fit that still moves and adds up
counts, sums and squared errors per (fit, cluster) inside the task, so jobs grow
with the number of steps, not with the values of k, restarts or tables. Each
task and the driver hold the centres of all fits: as many as the sum of the
values of k, times restarts, times tables.

Nothing depends on partitions but the last bits of sums. Points with equal
distances go to the centre with the smaller number. With fewer points than k
the fit has a centre for each point.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..functions.vectors import nearest

ROUNDS = 5  # passes that draw candidates
CELLS = 1 << 20  # distances held at once


class Clusters:
    """Centres of a fit and its squared error."""

    def __init__(self, centres, cost):
        self.centres, self.cost = np.asarray(centres, dtype=float), float(cost)

    @property
    def k(self):
        return len(self.centres)

    def clusterCenters(self):
        return list(self.centres)

    def transform(self, points, name="prediction"):
        """Add the number of the nearest centre of (x0, x1, ...)."""
        columns = [f"x{i}" for i in range(self.centres.shape[1])]
        return points.withColumn(name, nearest(columns, [list(c) for c in self.centres]))


def _nearest(x, centres):
    """Number of the nearest centre of each row, and the squared distance to it."""
    place, least = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, CELLS // len(centres))
    for at in range(0, len(x), step):
        d = _distances(x[at:at + step], centres)
        place[at:at + step] = d.argmin(axis=1)
        least[at:at + step] = d.min(axis=1)
    return place, least


def _distances(x, centres):
    d = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        apart = x[:, i, None] - centres[None, :, i]
        d += apart * apart
    return d


def _tables(batch, width):
    """(table, points, weights, hashes) for each table with rows in a batch."""
    own = batch.column(0).to_numpy()
    n, h = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
    x = np.column_stack([batch.column(3 + i).to_numpy() for i in range(width)])
    for t in np.unique(own):
        at = np.flatnonzero(own == t)
        yield int(t), x[at], n[at], h[at]


def _uniform(h, *salts):
    """Numbers in (0, 1) from 64-bit hashes, new ones for each salt."""
    with np.errstate(over="ignore"):
        for salt in salts:
            h = (h ^ np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _drawn(rows, width, chosen, restarts, turn, take):
    """{(table, restart): points}: up to ``take`` new points, likelier the more they add to the squared error."""
    def run(batches):
        best = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for t, x, n, h in _tables(batch, width):
                for r in range(restarts):
                    known = chosen.get((t, r))
                    weight = n if known is None else n * _nearest(x, known)[1]
                    some = np.flatnonzero(weight > 0)
                    key = -np.log(_uniform(h[some], turn, r)) / weight[some]
                    if (t, r) in best:
                        key = np.concatenate([best[t, r][0], key])
                        x_some = np.concatenate([best[t, r][1], x[some]])
                    else:
                        x_some = x[some]
                    if len(key) > take:
                        first = np.argpartition(key, take)[:take]
                        key, x_some = key[first], x_some[first]
                    best[t, r] = key, x_some
        for (t, r), (key, x) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(key), pa.int32()), pa.array([r] * len(key), pa.int32()), pa.array(key),
                 pa.array(x.tolist(), pa.list_(pa.float64()))], names=["t", "r", "key", "x"])

    found = rows.mapInArrow(run, "t int, r int, key double, x array<double>")
    place = F.row_number().over(Window.partitionBy("t", "r").orderBy("key", "x"))
    first = defaultdict(list)
    for row in found.withColumn("place", place).where(F.col("place") <= take).orderBy("t", "r", "place").collect():
        first[row["t"], row["r"]].append(row["x"])
    return {key: np.array(x) for key, x in first.items()}


def _sums(rows, width, fits):
    """{fit: (weights, sums, squared errors)} of the clusters of each fit {(table, ...): centres}."""
    keys = list(fits)
    of_table = defaultdict(list)
    for m, key in enumerate(keys):
        of_table[key[0]].append((m, fits[key]))
    sizes = [len(fits[key]) for key in keys]

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for t, x, n, _ in _tables(batch, width):
                for m, centres in of_table[t]:
                    place, d = _nearest(x, centres)
                    if m not in held:
                        held[m] = np.zeros((width + 2, len(centres)))
                    for i, v in enumerate((n, n * d, *(n * x[:, i] for i in range(width)))):
                        held[m][i] += np.bincount(place, v, len(centres))
        for m, table in held.items():
            k = table.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m] * k, pa.int32()), pa.array(range(k), pa.int32()), *map(pa.array, table)],
                names=["m", "c", *(f"s{i}" for i in range(width + 2))])

    columns = [f"s{i}" for i in range(width + 2)]
    parts = rows.mapInArrow(run, "m int, c int, " + ", ".join(f"{c} double" for c in columns))
    totals = [np.zeros((width + 2, size)) for size in sizes]
    for row in parts.groupBy("m", "c").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        totals[row["m"]][:, row["c"]] = [row[c] for c in columns]
    return {key: (t[0], t[2:].T, t[1]) for key, t in zip(keys, totals)}


def _spread(candidates, weights, k, rng):
    """k of the candidates, far ones likelier, the best of a few draws each (k-means++)."""
    draws = 2 + int(np.log(k))
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    least = _distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k and (least * weights).any():
        mass = least * weights
        tried = rng.choice(len(candidates), size=draws, p=mass / mass.sum())
        after = np.minimum(least[:, None], _distances(candidates, candidates[tried]))
        best = int((after * weights[:, None]).sum(axis=0).argmin())
        chosen.append(int(tried[best]))
        least = after[:, best]
    return candidates[chosen]


def _rows(points, seed):
    """(table, n, hash, x0, x1, ...) of points with a weight n and, where there are several, a table."""
    axes = [c for c in points.columns if c.startswith("x")]
    table = F.col("table") if "table" in points.columns else F.lit(0)
    return points.select(table.cast("int").alias("t"), F.col("n").cast("double").alias("n"),
                         F.xxhash64(F.lit(seed), *axes).alias("h"),
                         *[F.col(c).cast("double").alias(c) for c in axes]), len(axes)


def first_centres(points, ks, restarts, seed):
    """{(table, k, restart): centres} to start from."""
    rows, width = _rows(points, seed)
    chosen = {}
    for turn in range(ROUNDS + 1 if max(ks) > 1 else 1):
        for key, x in _drawn(rows, width, chosen, restarts, turn, 2 * max(ks) if turn else 1).items():
            chosen[key] = np.vstack([chosen[key], x]) if key in chosen else x
    weights = {key: found[0] for key, found in _sums(rows, width, chosen).items()}
    return {(t, k, r): _spread(x, weights[t, r], k, np.random.default_rng([seed, t, k, r]))
            for (t, r), x in chosen.items() for k in ks}


def fit_all(points, ks, restarts=10, seed=1, max_iter=50, tol=1e-4):
    """{table: {k: Clusters}}: the cheapest of the restarts for each k.

    ``points``: x0, x1, ... and a weight ``n``; rows with another ``table``
    number are fitted apart, in the same passes. A fit stops when no centre
    moves further than ``tol``. A fit keeps a centre that has lost its points.
    """
    rows, width = _rows(points, seed)
    fits = first_centres(points, [int(k) for k in ks], restarts, seed)
    moving = dict(fits)
    for _ in range(max_iter):
        if not moving:
            break
        for key, (n, sums, _) in _sums(rows, width, moving).items():
            held = n > 0
            after = moving[key].copy()
            after[held] = sums[held] / n[held, None]
            moved = ((after - moving[key]) ** 2).sum(axis=1).max()
            fits[key] = moving[key] = after
            if moved <= tol * tol:
                del moving[key]
    best = defaultdict(dict)
    for (t, k, r), (_, _, errors) in _sums(rows, width, fits).items():
        found = Clusters(fits[t, k, r], errors.sum())
        if k not in best[t] or found.cost < best[t][k].cost:
            best[t][k] = found
    return dict(best)


def silhouettes(points, fits):
    """{k: mean silhouette by squared distances} of fits {k: Clusters}, over all points in two passes.

    The mean squared distance from a point to a cluster is its squared distance
    to the mean of the cluster plus the variance of the cluster.
    """
    rows, width = _rows(points, 0)
    centres = {(0, k): f.centres for k, f in fits.items()}
    clusters = []
    for (_, k), (n, sums, errors) in _sums(rows, width, centres).items():
        size = np.maximum(n, 1e-300)
        means = np.where(n[:, None] > 0, sums / size[:, None], centres[0, k])
        spread = np.maximum(0, errors / size - ((means - centres[0, k]) ** 2).sum(axis=1))
        clusters.append((k, centres[0, k], n, means, np.where(n > 0, spread, np.inf)))

    def run(batches):
        held = {c[0]: 0.0 for c in clusters}
        total = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, x, n, _ in _tables(batch, width):
                total += n.sum()
                for k, centre, size, means, spread in clusters:
                    step = max(1, CELLS // len(centre))
                    for at in range(0, len(x), step):
                        part, w = x[at:at + step], n[at:at + step]
                        own, _ = _nearest(part, centre)
                        d = _distances(part, means) + spread
                        each = np.arange(len(part))
                        several = size[own] > 1
                        a = d[each, own] * size[own] / np.where(several, size[own] - 1, 1)
                        d[each, own] = np.inf
                        b = d.min(axis=1)
                        wider = np.maximum(a, b)
                        good = several & np.isfinite(b) & (wider > 0)
                        held[k] += (w[good] * (b[good] - a[good]) / wider[good]).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.float64()),
             pa.array([total] * len(held), pa.float64())], names=["k", "s", "n"])

    parts = rows.mapInArrow(run, "k int, s double, n double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return {r["k"]: r["s"] / r["n"] if r["n"] else 0.0 for r in parts.collect()}
