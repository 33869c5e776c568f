"""Exact positions without putting a group or a table into one task.

``exact_rank`` numbers rows by any order: one range shuffle on (group, order),
which cuts a hot group into many partitions, then offsets from the partition
sizes. ``hash_cuts`` finds the exact keys that split each group at given sizes
when the order is a hash: a histogram of hash prefixes (combined before the
shuffle, with more digits for larger groups) locates the one bucket that holds
the cut, and only the rows of that bucket are sorted. Applying cuts is a
map-side comparison.
"""

from pyspark.sql import Window, functions as F

from ..functions.hashing import hash_key
from .storage import settle


def exact_rank(df, order, group=(), name="rank"):
    """Add the 1-based position of each row in its group (whole table if none).

    ``order`` must be total: end it with a unique column.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(g) for g in group] + order
    placed = (df.repartitionByRange(*keys)
                .sortWithinPartitions(*keys)
                .withColumn("_at", F.monotonically_increasing_id()))
    placed = settle(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part", *group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *group, "_first",
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = placed["_part"] == F.col("p._part")
    parts = settle(parts, "offsets").alias("p")
    for g in group:
        same = same & placed[g].eqNullSafe(F.col(f"p.{g}"))
    out = placed.join(parts, same)
    rank = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return out.select(*[placed[c] for c in df.columns], rank.cast("long").alias(name))


def hash_cuts(df, ids, group, seed, targets):
    """For each group the keys of the rows at the given positions in hash order.

    ``targets`` maps the group size column to a list of 1-based positions in
    ascending order; position 0 means an empty part. Returns the group columns
    and one struct(h, ids...) per position: ``cut0``, ``cut1``, ...
    """
    group = [group] if isinstance(group, str) else list(group)
    ids = [ids] if isinstance(ids, str) else list(ids)
    keyed = df.select(*group, *ids, hash_key(ids, seed).alias("h"))
    sizes = settle(df.groupBy(*group).agg(F.count(F.lit(1)).alias("size")), "sizes")
    # Buckets of about 512 rows or less, whatever the size of the group.
    digits = F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("size") / 512))))
    sizes = sizes.withColumn("_digits", digits.cast("int"))
    if group:
        keyed = keyed.join(sizes, group)
    else:
        row = sizes.first()
        keyed = keyed.select("*", F.lit(row["size"]).alias("size"), F.lit(row["_digits"]).alias("_digits"))
    keyed = keyed.withColumn("_prefix", F.substr("h", F.lit(1), F.col("_digits"))).drop("_digits")

    counts = keyed.groupBy(*group, "size", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_prefix")
    counts = counts.withColumn("_upto", F.sum("_n").over(run))
    places = targets(F.col("size"))
    wanted = counts.select("*", F.posexplode(F.array(*places)).alias("k", "_target"))
    # An empty part ends before every row: it is noted at the first bucket.
    nothing = (F.col("_target") <= 0) & (F.col("_upto") == F.col("_n"))
    holds = ((F.col("_target") > F.col("_upto") - F.col("_n")) &
             (F.col("_target") <= F.col("_upto")))
    place = F.when(nothing, 0).otherwise(F.col("_target") - F.col("_upto") + F.col("_n"))
    edge = settle(wanted.where(nothing | holds).groupBy(*group, "_prefix").agg(
        F.collect_list(F.struct("k", place.alias("place"))).alias("_cuts")), "edges")

    close = keyed.join(edge, [*group, "_prefix"])
    at = F.row_number().over(Window.partitionBy(*group, "_prefix").orderBy("h", *ids))
    # Position 0 has no row of its own; the empty string sorts before every hash.
    hits = close.withColumn("_row", at).withColumn("_cuts", F.filter("_cuts", lambda c: (
        (c["place"] == F.col("_row")) | ((c["place"] == 0) & (F.col("_row") == 1))))) \
        .where(F.size("_cuts") > 0).select(*group, "size", *ids, "h", F.explode("_cuts").alias("_c"))
    first = F.col("_c.place") == 0
    found = hits.select(*group, "size", F.col("_c.k").alias("k"), F.when(first, "").otherwise(F.col("h")).alias("h"),
                        *[F.when(~first, F.col(i)).alias(i) for i in ids])
    key = F.struct("h", *ids)
    return settle(found.groupBy(*group).agg(*[
        F.first(F.when(F.col("k") == k, key), ignorenulls=True).alias(f"cut{k}")
        for k in range(len(places))]), "cuts")


def parts_by_cuts(df, cuts, ids, group, seed, name="part"):
    """Number of cuts that lie before each row: 0 for the first part, and so on."""
    group = [group] if isinstance(group, str) else list(group)
    ids = [ids] if isinstance(ids, str) else list(ids)
    own = F.struct(hash_key(ids, seed).alias("h"), *[F.col(i).alias(i) for i in ids])
    names = [c for c in cuts.columns if c not in group]
    if group:
        joined, ends = df.join(cuts, group, "left"), [F.col(c) for c in names]
    else:
        # One row of a handful of keys: literals, so no join at all.
        row, joined = cuts.first(), df
        ends = [F.struct(F.lit(row[c]["h"]).alias("h"), *[
            F.lit(row[c][i]).cast(df.schema[i].dataType).alias(i) for i in ids])
            for c in names if row and row[c]]
    part = F.lit(0)
    for end in ends:
        part = part + F.coalesce((end < own).cast("int"), F.lit(0))
    return joined.select(*df.columns, part.alias(name))
