"""Mixing sources to target weights by temperature.

The weight of a source is its share of all tokens to the power of an exponent
between 0 (all sources alike) and 1 (as they are). The exponent is bisected to
the largest one whose weights reach a target entropy, and raised again until no
source is repeated more often than a limit. The weights become a stream of
blocks: each source is read in passes, every pass in an order of its own, and
each block holds every source in proportion to its weight, in a random order.

Everything is DataFrame operations. Orders come from hashes of the ids, and
running totals from sums over prefixes of the hashes, so no source is ever
sorted in one task.
"""

import math

from pyspark.sql import Window, functions as F

from ..operators.storage import settle

TARGET_ENTROPY = 0.9  # of the entropy of equal weights
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
STEPS = 20  # bisections of the exponent, four in one pass over the sources
_AT_ONCE = 4
_PREFIX_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes_of(docs, doc_id="doc_id", text="text", source="source"):
    """(doc_id, source, n_tokens): words of the text, one at least; null sources are ''."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                       F.greatest(words, F.lit(1)).cast("long").alias("n_tokens"))


def _bisect(sources, fits, low, high, steps=STEPS):
    """Ends of the interval in which ``fits`` turns from true (low) to false (high).

    ``fits(exponent)`` is an aggregate over the sources. One pass evaluates all
    the midpoints that the next few halvings can meet.
    """
    for at in range(0, steps, _AT_ONCE):
        halvings = min(_AT_ONCE, steps - at)
        cells = 1 << halvings
        points = [low + (high - low) * i / cells for i in range(1, cells)]
        answers = sources.agg(*[fits(p).alias(f"p{i}") for i, p in enumerate(points)]).first()
        left, right = 0, cells
        while right - left > 1:
            middle = (left + right) // 2
            if answers[middle - 1]:
                left = middle
            else:
                right = middle
        width = (high - low) / cells
        low, high = low + width * left, low + width * right
    return low, high


def plan_mix(sizes, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS, budget=None,
             block_tokens=BLOCK_TOKENS):
    """One row per source: tokens, weight, quota, passes, n_blocks and digits.

    Without a ``budget`` of tokens the quotas are the smallest ones with the
    target weights that use every document at least once. ``passes`` counts the
    full readings of a source; the rest of its quota is part of one more.
    No sources give no rows.
    """
    sources = settle(sizes.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    count, total, largest = sources.agg(F.count(F.lit(1)), F.sum("tokens"), F.max("tokens")).first()
    if not count:
        return sources.select("source", "tokens", *[F.lit(0.0).alias(c) for c in ("exponent", "weight")],
                              *[F.lit(0).cast("long").alias(c) for c in ("quota", "passes", "n_blocks")],
                              F.lit(0).alias("digits"))
    share = F.col("tokens") / F.lit(float(total))
    goal = target_entropy * math.log(count)

    def even_enough(exponent):
        mass = F.sum(F.pow(share, F.lit(exponent)))
        logs = F.sum(F.pow(share, F.lit(exponent)) * F.log(share))
        return F.log(mass) - F.lit(exponent) * logs / mass >= F.lit(goal)

    def too_often(exponent):
        return F.pow(F.lit(float(largest)) / F.min("tokens"), F.lit(1.0 - exponent)) > F.lit(float(max_repeats))

    row = sources.agg(even_enough(1.0), too_often(0.0)).first()
    exponent = 1.0 if row[0] else _bisect(sources, even_enough, 0.0, 1.0)[0]
    if row[1]:
        exponent = max(exponent, _bisect(sources, too_often, 0.0, 1.0)[1])
    repeats = F.pow(F.lit(float(largest)) / F.col("tokens"), F.lit(1.0 - exponent))
    wanted = sources.agg(F.sum(F.floor(F.col("tokens") * repeats + 0.5)), F.sum(F.pow(share, F.lit(exponent)))).first()
    scale = 1.0 if budget is None else budget / float(wanted[0])
    blocks = max(1, -(-int(wanted[0] if budget is None else budget) // block_tokens))
    quota = F.floor(F.col("tokens") * repeats * F.lit(scale) + 0.5).cast("long")
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / _PREFIX_ROWS))).cast("int")
    return settle(sources.select(
        "source", "tokens", F.lit(exponent).alias("exponent"),
        (F.pow(share, F.lit(exponent)) / F.lit(wanted[1])).alias("weight"), quota.alias("quota"),
        F.floor(quota / F.col("tokens")).cast("long").alias("passes"),
        F.lit(blocks).cast("long").alias("n_blocks"), digits.alias("digits")), "mix_plan")


def _key(seed, epoch, doc_id):
    return F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), epoch.cast("string"),
                             F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _start(uses, name):
    """Add ``start``: tokens of the same pass of the same source before a use's key."""
    uses = settle(uses.withColumn("prefix", F.substr("key", F.lit(1), F.col("digits"))), name)
    part = ["source", "epoch", "prefix"]
    earlier = Window.partitionBy("source", "epoch").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(uses.groupBy(*part).agg(F.sum("n_tokens").alias("_n")).select(
        *part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), f"{name}_before")
    upto = F.sum("n_tokens").over(Window.partitionBy(*part).orderBy("key"))
    own = F.sum("n_tokens").over(Window.partitionBy(*part, "key"))
    return uses.withColumn("_within", upto - own).join(before, part).withColumn(
        "start", F.col("_before") + F.col("_within"))


def placements(sizes, plan, seed=0):
    """One row per use of a document: doc_id, source, n_tokens, epoch, block, slot.

    A use starts where the tokens before it in its pass end; rows that repeat a
    doc_id start together. Uses that start inside the quota of the source stay.
    """
    uses = (sizes.join(plan, "source")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
            .where("epoch * tokens < quota")
            .withColumn("key", _key(seed, F.col("epoch"), "doc_id"))
            .drop("exponent", "weight", "passes"))
    at = F.col("epoch") * F.col("tokens") + F.col("start")
    placed = _start(uses, "mix_uses").withColumn("_at", at).where("_at < quota")
    block = F.floor(F.col("_at") / F.col("quota").cast("double") * F.col("n_blocks")).cast("long")
    order = Window.partitionBy("block").orderBy("key", "doc_id", "source", "n_tokens")
    return placed.withColumn("block", block).select(
        "doc_id", "source", "n_tokens", "epoch", "block",
        (F.row_number().over(order) - 1).cast("long").alias("slot"))


def mix(docs, doc_id="doc_id", text="text", source="source", seed=0, **targets):
    """Placements of the documents in the mixed stream."""
    sizes = settle(sizes_of(docs, doc_id, text, source), "mix_sizes")
    return placements(sizes, plan_mix(sizes, **targets), seed)


def mixed_documents(docs, doc_id="doc_id", text="text", source="source", seed=0, **targets):
    """The documents themselves, each as often as the mixed stream uses it.

    Same uses as ``mix``: full passes, and one more for the documents up to the
    last key that the stream takes from the pass that its source ends in. Texts
    are not shuffled; the plan, one row per source, is joined to them.
    """
    sizes = settle(sizes_of(docs, doc_id, text, source), "mix_sizes")
    plan = plan_mix(sizes, **targets)
    names = docs.columns
    # Of the passes only the last one, which is read in part, has to be placed.
    part = plan.where("passes * tokens < quota").withColumnRenamed("passes", "epoch")
    part = sizes.join(part, "source").withColumn("key", _key(seed, F.col("epoch"), "doc_id"))
    taken = _start(part, "mix_last").where("epoch * tokens + start < quota")
    last = taken.groupBy("source").agg(F.max("key").alias("_last"))
    plan = settle(plan.join(last, "source", "left").select(
        F.col("source").alias("_source"), F.col("passes").alias("_passes"), "_last"), "mix_cuts")
    joined = docs.join(plan, F.coalesce(F.col(source), F.lit("")) == F.col("_source"))
    more = F.coalesce(_key(seed, F.col("_passes"), doc_id) <= F.col("_last"), F.lit(False)).cast("long")
    uses = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_passes") + more))
    return (joined.withColumn("_more", more).where("_passes + _more > 0")
            .withColumn("_use", uses).select(*[F.col(f"`{c}`") for c in names]))
