"""Exact, repeatable sampling and balancing, without a task per class."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_number
from .ranks import exact_rank, hash_cuts, parts_by_cuts
from .storage import attach, scalar_of, settle


def stratified_split(df, label, key="id", fraction=0.2, seed=2, name="is_holdout"):
    """Mark exactly round(fraction * n) rows of each label, half to even.

    Rows without a label are never marked. Only the key comparison touches the
    full rows; see ``hash_cuts``.
    """
    cuts = hash_cuts(df.where(F.col(label).isNotNull()), key, label, seed,
                     lambda n: [F.bround(n * fraction).cast("long")])
    parts = parts_by_cuts(df, cuts, key, label, seed, "_part")
    held = (F.col("_part") == 0) & F.col(label).isNotNull()
    return parts.withColumn(name, held).drop("_part")


def stratified_folds(df, label, key="id", k=5, seed=2, name="fold"):
    """Fold number 0..k-1 with class sizes that differ by at most one row."""
    def ends(n):
        return [(F.floor(n / k) * i + F.least(F.lit(i), n % k)).cast("long") for i in range(1, k)]
    cuts = hash_cuts(df, key, label, seed, ends)
    return parts_by_cuts(df, cuts, key, label, seed, name)


def ordered_folds(df, order, k=5, name="fold"):
    """Contiguous blocks in the given order; the first n mod k are one row longer."""
    ranked = exact_rank(df, order, name="_rank")
    n = ranked.count()
    size, extra = divmod(n, k)
    place = F.col("_rank") - 1
    long_rows = extra * (size + 1)
    fold = F.when(place < long_rows, F.floor(place / F.lit(size + 1))) \
            .otherwise(extra + F.floor((place - long_rows) / F.lit(max(size, 1))))
    return ranked.withColumn(name, fold.cast("int")).drop("_rank")


def random_sample(df, key="id", fraction=0.05, seed=1):
    """Exactly round(fraction * n) rows, the first in hash order."""
    cuts = hash_cuts(df, key, [], seed, lambda n: [F.bround(n * fraction).cast("long")])
    return parts_by_cuts(df, cuts, key, [], seed, "_part").where("_part = 0").drop("_part")


def hash_split(df, key="id", train_percent=70, seed=35, name="part"):
    """'train' or 'test' by the hash of the key: no shuffle, stable for ever."""
    bucket = F.pmod(hash_number(key, seed), F.lit(100))
    return df.withColumn(name, F.when(bucket < train_percent, "train").otherwise("test"))


def class_sizes(df, label):
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def weights_of_sizes(sizes, label):
    """(label, n, weight) from class sizes: total / (classes * n)."""
    rows = scalar_of(sizes, F.sum("n"))
    classes = scalar_of(sizes, F.count(F.lit(1)))
    return sizes.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))


def balanced_weights(df, label):
    """(label, n, weight) of the labels of a table."""
    return weights_of_sizes(settle(class_sizes(df, label), "class-sizes"), label)


def with_class_weight(df, label, name="weight"):
    """Give each row the balanced weight of its class."""
    weights = balanced_weights(df, label).select(label, F.col("weight").alias(name))
    return attach(df, weights, label, "left", "weights")


def oversample_smallest(df, label, key="id", seed=2):
    """Repeat rows of the smallest class until it is as large as the largest.

    Adds ``copy``: 0 for original rows. Draws are made in parallel and meet the
    minority rows by position; a tie for smallest goes to the first label. When
    draws per row are many the minority is small, its table is broadcast by its
    size and draws are not shuffled; otherwise draws per row are few.
    """
    row = class_sizes(df, label).agg(
        F.min_by(F.struct(label, "n"), F.struct("n", label)).alias("least"),
        F.max("n").alias("most")).first()
    originals = df.withColumn("copy", F.lit(0).cast("long"))
    if row["least"] is None or row["least"]["n"] == row["most"]:
        return originals
    smallest, few, many = row["least"][label], row["least"]["n"], row["most"]
    minority = df.where(F.col(label) == F.lit(smallest))
    placed = settle(exact_rank(minority, [key], name="_place"), "minority")
    draws = df.sparkSession.range(1, many - few + 1).select(
        F.col("id").alias("copy"),
        (F.pmod(hash_number("id", seed, 12), F.lit(few)) + 1).alias("_place"))
    copies = draws.join(placed, "_place").select(*df.columns, "copy")
    return originals.unionByName(copies)
