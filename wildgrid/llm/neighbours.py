"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed by a few tables; a table cuts Gaussian projections of
the vector into cells of equal width. A query looks into its own bucket and
into the buckets beside it, in the order of the probability that a neighbour
lies there, given how far the query's projections are from the cell borders.
The candidates of all probes and tables are merged, and ranked by the exact
inner product of the original vectors.

Largest inner products are nearest neighbours on a sphere: vectors get one more
component that brings all of them to the longest norm, queries a zero there.
Buckets are cut into blocks of bounded size, and blocks of queries meet blocks
of vectors, so a bucket that holds a third of all vectors is many small tasks
and nothing is capped.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..operators.storage import settle
from .common import batches_of

TABLES, PROJECTIONS, WIDTH, PROBES = 1, 4, 1.5, 80
# Typical cosine between a query and its neighbours on the sphere; it only
# orders the probes.
COSINE = 0.4
VECTOR_BLOCK, QUERY_BLOCK = 2048, 512
REACH = 2  # cells to each side that a probe may move along a projection


class Hashing:
    """Projections of one set of tables; the same on every worker for a seed."""

    def __init__(self, dimensions, longest, tables, projections, width, seed):
        drawn = np.random.default_rng([seed, dimensions, tables, projections])
        self.longest, self.width, self.tables, self.projections = longest, width, tables, projections
        self.along = drawn.normal(size=(tables, dimensions + 1, projections))
        self.shift = drawn.uniform(0, width, size=(tables, projections))

    @staticmethod
    def codes(cells):
        """One number for the cells of all projections."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for k in range(cells.shape[-1]):
            out = out * 256 + np.clip(cells[..., k] + 128, 0, 255)
        return out

    def buckets(self, vectors, table):
        """Bucket of each stored vector."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(axis=1, keepdims=True)))
        places = np.hstack([scaled, rest]) @ self.along[table] + self.shift[table]
        return self.codes(np.floor(places / self.width).astype(np.int64))

    def probes(self, vectors, table, count, cosine):
        """Buckets to look into for each query, most promising first."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        places = unit @ self.along[table][:-1]
        own = np.floor((places + self.shift[table]) / self.width).astype(np.int64)
        steps = np.arange(-REACH, REACH + 1)
        cells = own[:, :, None] + steps
        low = cells * self.width - self.shift[table][None, :, None]
        # A neighbour's projection is normal around cosine times the query's.
        spread = math.sqrt(1 - cosine ** 2)
        z = (low - cosine * places[:, :, None]) / spread
        chance = np.log(np.maximum(_normal(z + self.width / spread) - _normal(z), 1e-30))
        moves = np.array(list(itertools.product(range(len(steps)), repeat=self.projections)))
        score = sum(chance[:, k, moves[:, k]] for k in range(self.projections))
        best = np.argsort(-score, axis=1, kind="stable")[:, :count]
        chosen = moves[best]
        found = np.stack([np.take_along_axis(cells[:, k, :], chosen[:, :, k], axis=1)
                          for k in range(self.projections)], axis=-1)
        return self.codes(found)


def _normal(z):
    """Distribution function of the standard normal."""
    return 0.5 * (1 + np.frompyfunc(math.erf, 1, 1)(z / math.sqrt(2)).astype(float))


def valid_vectors(rows, vec_id="vec_id", vector="embedding"):
    """(vec_id, vector) of rows with an id and a finite, non-zero vector of the usual length.

    The usual length is the most frequent one (of several the largest).
    """
    values = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) &
        F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0)), (usual["n"] if usual else 0)


def _hashed(rows, hashing, probes=None, cosine=COSINE):
    """(table, bucket, vec_id, raw): one row per table, or per table and probe."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            flat = batch.column(1).flatten().to_numpy()
            vectors = flat.reshape(len(ids), -1)
            raw = [v.tobytes() for v in vectors]
            for table in range(hashing.tables):
                if probes is None:
                    buckets, at = hashing.buckets(vectors, table), np.arange(len(ids))
                else:
                    found = hashing.probes(vectors, table, probes, cosine)
                    buckets, at = found.ravel(), np.repeat(np.arange(len(ids)), found.shape[1])
                yield pa.RecordBatch.from_pydict({
                    "tab": pa.array(np.full(len(at), table), pa.int32()), "bucket": pa.array(buckets, pa.int64()),
                    "vec_id": pa.array(ids[at], pa.int64()), "raw": pa.array([raw[i] for i in at], pa.binary())})

    return rows.mapInArrow(run, "tab int, bucket long, vec_id long, raw binary")


def _blocks(hashed, size, prefix):
    """Rows of a bucket gathered into blocks of about ``size`` rows."""
    chunks = settle(hashed.groupBy("tab", "bucket").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks")), f"{prefix}_buckets")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(prefix)), F.col("chunks"))
    return hashed.join(chunks, ["tab", "bucket"]).groupBy("tab", "bucket", chunk.alias("chunk")).agg(
        F.collect_list(F.struct("vec_id", "raw")).alias("rows")).select(
            "tab", "bucket", F.col("rows.vec_id").alias(f"{prefix}_ids"), F.col("rows.raw").alias(f"{prefix}_raw"))


def _ranked(pairs, dimensions, k):
    """(query_id, vec_id, score): the best k of each query in every pair of blocks."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, x_ids = (np.asarray(batch.column(c)[row].values) for c in (0, 2))
                q, x = (np.frombuffer(b"".join(batch.column(c)[row].as_py()), np.float64).reshape(-1, dimensions)
                        for c in (1, 3))
                products = q @ x.T
                products[q_ids[:, None] == x_ids[None, :]] = -np.inf
                out_q, out_x, out_s = [], [], []
                for i, line in enumerate(products):
                    # All that rounding or a tie could bring among the best k.
                    least = -np.inf
                    if len(line) > k:
                        least = np.partition(line, len(line) - k)[len(line) - k]
                    near = np.flatnonzero((line >= least - 1e-9 * (1 + abs(least))) & (line > -np.inf)) \
                        if least > -np.inf else np.flatnonzero(line > -np.inf)
                    exact = (x[near] * q[i]).sum(axis=1)
                    order = np.lexsort((x_ids[near], -exact))[:k]
                    out_q.append(np.full(len(order), q_ids[i]))
                    out_x.append(x_ids[near][order])
                    out_s.append(exact[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q), pa.int64()), pa.array(np.concatenate(out_x), pa.int64()),
                     pa.array(np.concatenate(out_s), pa.float64())], names=["query_id", "vec_id", "score"])

    columns = pairs.select("q_ids", "q_raw", "x_ids", "x_raw")
    return columns.mapInArrow(run, "query_id long, vec_id long, score double")


def _merged(found, k):
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(rows, queries, vec_id="vec_id", vector="embedding", k=20, tables=TABLES, projections=PROJECTIONS,
            width=WIDTH, probes=PROBES, cosine=COSINE, seed=0):
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    ``queries`` is a condition on the rows; a query's own id is no candidate.
    Ties go to the smaller vec_id. A query whose probes find fewer than k
    candidates, while there are more, is compared with all vectors, block by
    block. Rows without an id or with a null, zero, non-finite or oddly long
    vector take no part; a repeated id with two vectors is two candidates.
    """
    with batches_of(rows.sparkSession, 1024) as few:
        return _nearest(rows, queries, vec_id, vector, k, tables, projections, width, probes, cosine, seed, few)


def _nearest(rows, queries, vec_id, vector, k, tables, projections, width, probes, cosine, seed, few):
    valid, dimensions = valid_vectors(rows, vec_id, vector)
    valid = settle(valid, "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    count, longest = valid.agg(F.countDistinct("vec_id"), F.sqrt(F.max(squares))).first()
    hashing = Hashing(dimensions, longest or 1.0, tables, projections, width, seed)
    asked = valid.where(queries)
    stored = settle(_hashed(valid, hashing), "hashed")
    wanted = settle(_hashed(asked, hashing, probes, cosine), "probes")
    few(4)  # rows are blocks from here on
    blocks = settle(_blocks(stored, VECTOR_BLOCK, "x"), "x_blocks")
    pairs = _blocks(wanted, QUERY_BLOCK, "q").join(blocks, ["tab", "bucket"])
    found = settle(_merged(_ranked(pairs, dimensions, k), k), "found")

    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, max(count - 1, 0)))
    short = settle(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if count > 1 and not short.isEmpty():
        # Each vector stands once in the blocks of the first table.
        own = _blocks(_hashed(short, hashing, 1).where("tab = 0"), QUERY_BLOCK, "q")
        every = blocks.where("tab = 0").select("x_ids", "x_raw")
        whole = _ranked(own.crossJoin(every), dimensions, k)
        found = settle(_merged(found.drop("rank").unionByName(whole), k), "found_all")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
