"""Counts, summaries, month profiles and data checks."""

from pyspark.sql import functions as F

from .quantiles import exact_quantiles, long_form, wide_quantiles
from .storage import attach, scalar_of

MONTHS = list(range(1, 13))


def value_counts(df, column, ascending=False):
    """Rows per value, nulls left out, most frequent first (ties by value)."""
    order = F.asc("n") if ascending else F.desc("n")
    return df.where(F.col(column).isNotNull()).groupBy(column) \
             .agg(F.count(F.lit(1)).alias("n")).orderBy(order, column)


def level_counts(df, levels):
    """Rows per label at each level, in one pass over the data."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in levels])
    return text.unpivot([], list(levels), "level", "label").where("label is not null") \
               .groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"))


def two_key_counts(df, a, b):
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df, columns, approximate=False):
    """Distinct values per column as (column, n_distinct), one pass."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    rows = text.unpivot([], list(columns), "column", "value").where("value is not null")
    count = F.approx_count_distinct("value") if approximate else F.count_distinct("value")
    return rows.groupBy("column").agg(count.alias("n_distinct"))


def level_labels(df, levels):
    """Distinct labels per level; a row counts down to its first null level."""
    text = [F.col(c).cast("string") for c in levels]
    entries = []
    unbroken = F.lit(True)
    for c, t in zip(levels, text):
        unbroken = unbroken & t.isNotNull()
        entries.append(F.when(unbroken, F.struct(F.lit(c).alias("level"), t.alias("label"))))
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")) \
             .select("e.*").distinct()


def large_classes(df, label, at_least=5, counted="common_name"):
    """Rows of labels with enough rows; ``counted`` nulls do not count.

    Class sizes are aggregated first and joined back as a small table.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label) \
              .agg(F.count(F.col(counted)).alias("_n"))
    return attach(df, sizes.where(F.col("_n") >= at_least).select(label), label,
                  "left_semi", "large-classes")


def with_group_value(df, group, aggregate, name):
    """Give every row an aggregate of its group (the group itself may be null)."""
    values = df.groupBy(group).agg(aggregate.alias(name)).where(F.col(group).isNotNull())
    return attach(df, values, group, "left", "group-value").select(*df.columns, name)


def impute_group_mean(df, column, group, means=None):
    """Fill nulls with the mean of the row's group.

    ``means`` (group, mean) fitted on training rows is for scoring, where the
    group must be something known at that time.
    """
    if means is None:
        means = group_means(df, column, group)
    out = attach(df, means.withColumnRenamed("mean", "_mean"), group, "left", "means")
    return out.withColumn(column, F.coalesce(F.col(column), F.col("_mean"))).select(*df.columns)


def group_means(df, column, group):
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(column).alias("mean"))


def month_profile(df, label, month, measures):
    """Mean of each measure by (label, month)."""
    return df.groupBy(label, month.alias("month")).agg(*[F.avg(m).alias(m) for m in measures])


def month_pivot(profile, label, measure, prefix="m"):
    """One column per month; the month list is fixed, so no extra pass."""
    cells = [F.max(F.when(F.col("month") == m, F.col(measure))).alias(f"{prefix}{m}") for m in MONTHS]
    return profile.groupBy(label).agg(*cells)


def fill_row_mean(df, columns):
    """Fill empty cells with the mean of the row's other cells."""
    cells = F.array_compact(F.array(*[F.col(c) for c in columns]))
    mean = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells))
    filled = df.withColumn("_mean", mean)
    return filled.select(*[F.coalesce(F.col(c), F.col("_mean")).alias(c) if c in columns
                           else F.col(c) for c in df.columns])


def describe_numeric(df, columns):
    """count, mean, std, min, quartiles, max per column, quartiles exact."""
    base = long_form(df, columns).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = wide_quantiles(exact_quantiles(df, columns, [0.25, 0.5, 0.75]),
                       {0.25: "q25", 0.5: "q50", 0.75: "q75"}, ["column"])
    return base.join(q, "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_text(df, columns):
    """count, distinct values, most frequent value and its count per column."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = text.unpivot([], list(columns), "column", "value").where("value is not null") \
                 .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def histogram(df, column, bins=10):
    """Equal-width bins between minimum and maximum; the last one is closed."""
    c = F.col(column).cast("double")
    lo, hi = scalar_of(df, F.min(c)), scalar_of(df, F.max(c))
    marked = df.where(c.isNotNull()).select(c.alias("x"), lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), 1).otherwise(
        F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)) + 1, F.lit(bins)))
    return marked.groupBy(number.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("lo").alias("_lo"), F.min(width).alias("_w")).select(
        "bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("left_edge"), "n")


def class_size_quantiles(df, label, probabilities=(0.25, 0.5, 0.75), more_than=0):
    """Quantiles of the class sizes, for classes above a size."""
    sizes = value_counts(df, label).where(F.col("n") > more_than).withColumnRenamed("n", "size")
    return exact_quantiles(sizes, ["size"], probabilities).select("p", "n", "value")


def mean_interval(df, value, group, low=0.025, high=0.975):
    """Mean with a percentile interval per group."""
    q = wide_quantiles(exact_quantiles(df, [value], [low, high], [group]),
                       {low: "low", high: "high"}, [group])
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    return means.join(q, group, "left")


def null_audit(df, columns=None):
    """(column, nulls, has_null) for every column, one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls") \
                 .withColumn("has_null", F.col("nulls") > 0)


def null_gate(df, columns):
    """(rows without nulls in the columns, the others): instead of stopping."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(~missing), df.where(missing)


def expectations(df, checks):
    """(check, violations, passed): rows that break each condition, one pass.

    ``checks`` maps a name to a condition; a condition that is null is broken.
    """
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.unpivot([], list(checks), "check", "violations") \
                 .withColumn("passed", F.col("violations") == 0)


def shape(df):
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")) \
             .withColumn("n_columns", F.lit(len(df.columns)))


def transpose(df, key, columns, keys):
    """Rows of a small report become columns; ``keys`` are the new column names."""
    rows = df.unpivot([key], list(columns), "column", "value")
    cells = [F.max(F.when(F.col(key) == k, F.col("value"))).alias(str(k)) for k in keys]
    return rows.groupBy("column").agg(*cells)


def top(df, order, n):
    """First n rows by an order; each task keeps n rows only."""
    return df.orderBy(*order).limit(n)


def positions(df, order, start, end):
    """Rows at positions [start, end) of an order, counted from 0.

    By exact rank: no task sorts the rows before them. The order must be total.
    """
    from .ranks import exact_rank

    ranked = exact_rank(df, list(order), name="_rank")
    return ranked.where((F.col("_rank") > start) & (F.col("_rank") <= end)).drop("_rank")


def in_given_order(df, column, keys):
    """Rows of the listed keys, sorted as listed."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(column))
    return df.where(F.col(column).isin(*keys)).withColumn("place", place.cast("int")).orderBy("place")
