"""Exact k-means in integers with Shallot search.

A vector is one row with its integer components as bytes, and what bounds the
search: its nearest and second nearest centroid, a distance that the first is
not beyond, and one that no other centroid is nearer than. Moved centroids
widen the bounds. A vector whose bounds still part the nearest from the rest is
not looked at. Else the search starts from the closer of the two remembered
centroids and visits the others in the order of their distance from it, inside
a ball that shrinks with every nearer one found. Bounds are rounded outwards,
and those that survive them are compared by squared distances in integers, so
ties are decided exactly.

Each round reads the rows once and writes them with their new state, and with
the sums of the vectors that changed sides, one row for each Arrow batch.
Driver and workers share only the centroids and their mutual distances.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.storage import forget, settle

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
# Components beyond this have no exact sums in 64 bits.
LARGEST = 2 ** 47
ROUNDING = 1e-12
STATE = "vec_id long, vector binary, near int, second int, upper double, lower double, sums array<long>"
WIDTHS = (np.int16, np.int32, np.int64)


def wide_enough(rows, others):
    """Rows as they are if squared distances to the others fit in 64 bits, else as Python integers."""
    most = sum(max(int(r.max(initial=0)), -int(r.min(initial=0))) for r in (rows, others))
    return rows if most * most * max(1, rows.shape[1]) < 2 ** 63 else rows.astype(object)


def squared(rows, centres):
    """Exact squared distances of rows to one centroid each."""
    step = rows - centres
    return (step * step).sum(axis=1)


def _root(squares):
    return np.sqrt(squares.astype(float))


class Centroids:
    """Integer centroids with their mutual distances and how far each has moved."""

    def __init__(self, rows, before=None):
        self.rows = np.asarray(rows, np.int64)
        k = len(self.rows)
        exact = wide_enough(self.rows, self.rows)
        apart = np.array([_root(squared(exact, c)) for c in self.rows]).reshape(k, k)
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.apart[:, 0] / 2 * (1 - ROUNDING) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else _root(squared(
            wide_enough(self.rows, before.rows), before.rows))
        self.moved = moved * (1 + ROUNDING)
        ranked = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(k, self.moved[ranked[0]])
        self.others_moved[ranked[0]] = self.moved[ranked[1]] if k > 1 else 0.0

    def search(self, rows, start, other):
        """(nearest, second, their squared distances): exact, the smaller number wins a tie."""
        d_start, d_other = squared(rows, self.rows[start]), squared(rows, self.rows[other])
        swap = (d_other < d_start) | ((d_other == d_start) & (other < start))
        best, second = np.where(swap, other, start), np.where(swap, start, other)
        d_best, d_second = np.where(swap, d_other, d_start), np.where(swap, d_start, d_other)
        centre, reach = best.copy(), _root(d_best) * (1 + ROUNDING)
        at = np.arange(len(rows))
        for place in range(self.order.shape[1]):
            ball = reach[at] + _root(d_second[at]) * (1 + ROUNDING)
            at = at[self.apart[centre[at], place] <= ball]
            if not len(at):
                break
            number = self.order[centre[at], place]
            fresh = (number != best[at]) & (number != second[at])
            look, number = at[fresh], number[fresh]
            d = squared(rows[look], self.rows[number])
            first = (d < d_best[look]) | ((d == d_best[look]) & (number < best[look]))
            next_one = ~first & (d < d_second[look])
            second[look[first]], d_second[look[first]] = best[look[first]], d_best[look[first]]
            best[look[first]], d_best[look[first]] = number[first], d[first]
            second[look[next_one]], d_second[look[next_one]] = number[next_one], d[next_one]
        return best, second, d_best, d_second

    def assign(self, rows, near, second, upper, lower):
        """The state of every row after the centroids have moved; near is -1 before the first round."""
        near, second, rows = near.copy(), second.copy(), wide_enough(rows, self.rows)
        if len(self.rows) == 1:
            return np.zeros_like(near), np.zeros_like(near), np.full(len(rows), np.inf), np.full(len(rows), np.inf)
        new = near < 0
        near[new], second[new] = 0, 1
        upper = np.where(new, np.inf, (upper + self.moved[near]) * (1 + ROUNDING))
        lower = np.where(new, 0.0, np.maximum(0.0, lower - self.others_moved[near]) * (1 - ROUNDING))
        safe = np.maximum(lower, self.half[near])
        open_rows = np.flatnonzero(~(upper < safe))
        upper[open_rows] = _root(squared(rows[open_rows], self.rows[near[open_rows]])) * (1 + ROUNDING)
        open_rows = open_rows[~(upper[open_rows] < safe[open_rows]) | new[open_rows]]
        found = self.search(rows[open_rows], near[open_rows], second[open_rows])
        near[open_rows], second[open_rows] = found[0], found[1]
        upper[open_rows] = _root(found[2]) * (1 + ROUNDING)
        lower[open_rows] = _root(found[3]) * (1 - ROUNDING)
        return near, second, upper, lower


def valid_vectors(rows, vec_id="vec_id", vector="embedding", dimensions=DIMENSIONS, scale=SCALE):
    """(vec_id, values): rows with exactly that many components, none null or non-finite.

    Components whose integer has no exact sums in 64 bits (beyond 2^47) count as
    non-finite. A null vec_id is kept.
    """
    values = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("_given"), values.alias("values"))
    return rows.where(F.size("_given") == dimensions).where(F.forall("_given", lambda x: x.isNotNull() & (
        F.abs(x.cast("double")) * scale < LARGEST))).select("vec_id", "values")


def first_centroids(rows, clusters=CLUSTERS, seed=SEED):
    """The vectors of the smallest sha256 of ``seed:vec_id``, in that order; of equal ids the smaller vector."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    picked = rows.select(F.sha2(name, 256).alias("h"), "values").orderBy("h", "values").limit(clusters)
    return [[int(x) for x in r["values"]] for r in picked.collect()]


def _unpacked(column, dimensions):
    """Rows of one batch as a 64-bit matrix, whatever width each was stored in."""
    raw = column.to_pylist()
    out = np.empty((len(raw), dimensions), np.int64)
    sizes = np.array([len(r) for r in raw])
    for width in WIDTHS:
        same = np.flatnonzero(sizes == np.dtype(width).itemsize * dimensions)
        if len(same):
            out[same] = np.frombuffer(b"".join(raw[i] for i in same), width).reshape(-1, dimensions)
    return out


def _packed(values):
    """Bytes of each row in the narrowest of the widths that hold the whole batch."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    width = next(w for w in WIDTHS if most <= np.iinfo(w).max)
    return [r.tobytes() for r in values.astype(width)]


def _stored(rows, dimensions):
    """Vectors in their first state: bytes, no centroid yet."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(n, dimensions)
            none = np.full(n, -1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_packed(values), pa.binary()), pa.array(none), pa.array(none),
                 pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "vector", "near", "second", "upper", "lower", "sums"])

    return rows.mapInArrow(run, STATE)


def _assigned(state, centroids):
    """The rows with their next state, and one row of sums for each batch in which some changed sides."""
    k, dimensions = centroids.rows.shape

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = _unpacked(batch.column(1), dimensions)
            before = batch.column(2).to_numpy()
            near, second, upper, lower = centroids.assign(
                rows, before, *(batch.column(c).to_numpy() for c in (3, 4, 5)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(second, pa.int32()),
                 pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64()))], names=batch.schema.names)
            moved = np.flatnonzero(near != before)
            if not len(moved):
                continue
            with_count = np.hstack([np.ones((len(moved), 1), np.int64), rows[moved]])
            sums = np.zeros((k, dimensions + 1), np.int64)
            np.add.at(sums, near[moved], with_count)
            old = before[moved] >= 0
            np.subtract.at(sums, before[moved][old], with_count[old])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
                + [pa.array([sums.ravel()], pa.list_(pa.int64()))], names=batch.schema.names)

    return state.where("sums is null").select(*STATE_COLUMNS).mapInArrow(run, STATE)


STATE_COLUMNS = [part.split()[0] for part in STATE.split(", ")]


def _changes(state, k, dimensions):
    """What the last round adds to the count and sums of each cluster, exact: k x (dimensions + 1) numbers."""
    cells = state.where("sums is not null").select(F.posexplode("sums").alias("cell", "x"))
    rows = cells.groupBy("cell").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [[0] * (dimensions + 1) for _ in range(k)]
    for r in rows:
        out[r["cell"] // (dimensions + 1)][r["cell"] % (dimensions + 1)] = int(r["x"])
    return out


def fit(rows, vec_id="vec_id", vector="embedding", clusters=CLUSTERS, rounds=ROUNDS, dimensions=DIMENSIONS,
        scale=SCALE, seed=SEED):
    """(state, centroids): vectors assigned to the centroids after so many rounds.

    Components become integers floor(scale * x). A round assigns every vector to
    its nearest centroid and moves each centroid that has vectors to the
    componentwise floor of their mean. Fewer vectors than clusters give fewer
    centroids. A round in which no centroid moves ends the search: all later
    ones would be alike. Without vectors, centroids is None.
    """
    valid = valid_vectors(rows, vec_id, vector, dimensions, scale)
    first = first_centroids(valid, clusters, seed)
    if not first:
        return None, None
    state = settle(_stored(valid, dimensions), "vectors")
    centroids = Centroids(first)
    totals = [[0] * (dimensions + 1) for _ in first]
    for _ in range(rounds):
        following = settle(_assigned(state, centroids), "vectors")
        forget(state)
        state = following
        change = _changes(state, len(first), dimensions)
        totals = [[a + b for a, b in zip(x, y)] for x, y in zip(totals, change)]
        means = [[s // t[0] for s in t[1:]] if t[0] else [int(c) for c in old]
                 for t, old in zip(totals, centroids.rows)]
        moved = Centroids(means, centroids)
        if not moved.moved.any():
            break
        centroids = moved
    return state, centroids


def _with_distances(state, centroids):
    """(vec_id, cluster, distance): the last assignment with exact squared distances.

    A distance that no long can hold is null.
    """
    dimensions = centroids.rows.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unpacked(batch.column(1), dimensions)
            near = centroids.assign(rows, *(batch.column(c).to_numpy() for c in (2, 3, 4, 5)))[0]
            d = squared(wide_enough(rows, centroids.rows), centroids.rows[near])
            fits = [int(x) if x < 2 ** 63 else None for x in d] if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(fits, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return state.where("sums is null").select(*STATE_COLUMNS).mapInArrow(
        run, "vec_id long, cluster int, distance long")


def cluster_vectors(rows, vec_id="vec_id", vector="embedding", **options):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every valid vector.

    Null vectors and those with another number of components, or with a null or
    non-finite one, take no part; repeated rows are vectors of their own. Sums
    that no long can hold are null. ``options`` as for ``fit``.
    """
    spark = rows.sparkSession
    state, centroids = fit(rows, vec_id, vector, **options)
    if centroids is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    found = settle(_with_distances(state, centroids), "assigned")
    forget(state)
    per_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    held = lambda x: x if x is None or x < 2 ** 63 else None
    whole = held(sum(int(r["d"] or 0) for r in per_cluster))
    facts = [(r["cluster"], held(None if r["d"] is None else int(r["d"])), whole, hashlib.sha256(
        ",".join(str(int(x)) for x in centroids.rows[r["cluster"]]).encode()).hexdigest()) for r in per_cluster]
    facts = settle(spark.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string").coalesce(1), "clusters")
    return found.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
