"""Exact quantiles with linear interpolation, for many columns at once.

Passes over the values, no sort of them: each counts the values of a span into
cells of equal width (combined before the shuffle) and keeps only the cells
that hold a wanted position as the spans of the next pass. Once spans are
short, their distinct values are counted and ranked. Results are exact however
the values are spread; the spread only decides the number of passes.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from .storage import settle

CELLS = 1024
SHORT_SPAN = 4096  # rows of a span that are ranked by value
PASSES = 6


def long_form(df, columns, group=()):
    """(group, column, value) without nulls, as doubles."""
    group = list(group)
    doubles = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(group, list(columns), "column", "value") \
                  .where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df, columns, probabilities, group=()):
    """Rows (group, column, p, n, value): the value at (n-1)*p, interpolated."""
    group = [group] if isinstance(group, str) else list(group)
    key = [*group, "column"]
    values = long_form(df, columns, group)
    spans = values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("p")
    wanted = spans.select(*key, F.col("rows").alias("total"), p, "rows", "lo", "hi", F.lit(0).cast("long").alias("before"))
    wanted = wanted.withColumn("pos", (F.col("total") - 1) * F.col("p"))
    wanted = settle(wanted.select(
        *key, "p", "total", "pos", "rows", "lo", "hi", "before", F.explode(F.array(
            F.struct(F.lit("lo").alias("side"), F.floor("pos").alias("place")),
            F.struct(F.lit("hi").alias("side"), F.ceil("pos").alias("place")))).alias("w"))
        .select(*key, "p", "total", "pos", "rows", "lo", "hi", "before", "w.side", "w.place"), "wanted")
    long_span = (F.col("rows") > SHORT_SPAN) & (F.col("lo") < F.col("hi"))
    for _ in range(PASSES):
        if wanted.where(long_span).isEmpty():
            break
        wanted = settle(_narrowed(values, wanted.where(long_span), key).unionByName(
            wanted.where(~long_span)), "wanted")

    short = wanted.select(*key, "lo", "hi", "before").distinct()
    inside = _inside(values, short, key).groupBy(*key, "lo", "before", "value").agg(F.count(F.lit(1)).alias("same"))
    run = Window.partitionBy(*key, "lo", "before").orderBy("value")
    ranked = inside.withColumn("upto", F.col("before") + F.sum("same").over(run))
    found = _matched(wanted.drop("rows", "hi"), ranked, [*key, "lo", "before"]).where(
        (F.col("place") >= F.col("upto") - F.col("same")) & (F.col("place") < F.col("upto")))
    lo = F.max(F.when(F.col("side") == "lo", F.col("value")))
    hi = F.max(F.when(F.col("side") == "hi", F.col("value")))
    part = F.first(F.col("pos") - F.floor("pos"))
    return found.groupBy(*key, "p").agg(
        F.first("total").alias("n"), (lo + (hi - lo) * part).alias("value"))


def _matched(left, right, on):
    """Inner join on columns that may be null, with the columns of both."""
    right = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return left.join(right, same).drop(*[f"_{c}" for c in on])


def _inside(values, spans, key):
    """Values with the spans that they lie in; the spans are a few per key."""
    met = _matched(values, spans, key)
    return met.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def _narrowed(values, wanted, key):
    """The wanted positions with the cell of their span that holds them as new span."""
    spans = wanted.select(*key, "lo", "hi", "before").distinct()
    part = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS
    # Infinite ends leave no finite width: such values go to the first or last cell.
    cell = F.when(F.isnan(part), F.when(F.col("value") > 0, CELLS - 1).otherwise(0)).otherwise(
        F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(part)))).cast("int")
    cells = _inside(values, spans, key).groupBy(*key, F.col("lo").alias("of"), F.col("before").alias("base"),
                                                cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    run = Window.partitionBy(*key, "of", "base").orderBy("cell")
    cells = cells.withColumn("before", F.col("base") + F.sum("rows").over(run) - F.col("rows"))
    places = wanted.drop("rows", "hi").withColumnsRenamed({"lo": "of", "before": "base"})
    met = _matched(places, cells.drop("cell"), [*key, "of", "base"])
    return met.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("rows"))) \
              .drop("of", "base")


def wide_quantiles(quantiles, names, key):
    """One row per key with a column for each probability in ``names``."""
    cells = [F.max(F.when(F.abs(F.col("p") - q) < 1e-9, F.col("value"))).alias(n)
             for q, n in names.items()]
    return quantiles.groupBy(*key).agg(*cells)


def union_all(frames):
    """Append by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
