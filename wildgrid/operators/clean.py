"""Cleaning: first-come dedupe, resume, null gate, quarantine, dates, local times."""

from pyspark.sql import functions as F, types as T

from ..functions import times
from ..functions.text import POOR_QUALITY_WORDS, mentions
from ..schemas import INTERIM_COLUMNS
from .storage import settle

WORKING_COLUMNS = ["observed_on", "latitude", "longitude", "time_observed_at", "time_zone"]


def least_rows(df, key):
    """One row per key, the least of them column by column: the same row whatever the partitions.

    Rows with a column that cannot be compared, such as a map, are ordered by
    their JSON text. Combined before the shuffle, so a hot key is one row per task.
    """
    key = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    plain = all(_comparable(f.dataType) for f in df.schema.fields)
    least = F.min(row) if plain else F.min_by(row, F.to_json(row))
    return df.groupBy(*key).agg(least.alias("_row")).select("_row.*")


def _comparable(kind):
    """Whether values of a type have an order."""
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.UserDefinedType))


def dedupe_first(df, key="id", order="input_order"):
    """One row per key, the first in the given order; of rows with equal order the least.

    The least order of each key is a hash aggregate over the narrow columns,
    combined before the shuffle, so a key that holds a third of all rows
    arrives as one row per task. Whole rows move once, to meet it; only keys
    that may have ties, of three rows or of equal orders, are aggregated as rows.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    least = df.select(*key, at.alias("_at")).groupBy(*key).agg(
        F.min("_at").alias("_least"), F.max("_at").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    tied = (F.col("_rows") > 2) | ((F.col("_rows") == 2) & F.col("_least").eqNullSafe(F.col("_most")))
    least = settle(least.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(key)], "_least", tied.alias("_tied")),
                   "first")
    same = at.eqNullSafe(F.col("_least"))
    for i, c in enumerate(key):
        same = same & df[c].eqNullSafe(F.col(f"_{i}"))
    met = df.join(least, same)
    single = met.where("not _tied").select(*[df[c] for c in df.columns])
    return single.unionByName(least_rows(met.where("_tied").select(*[df[c] for c in df.columns]), key))


def without(df, *done, key="id"):
    """Rows whose key occurs in none of the given tables (resume, key difference)."""
    keys = None
    for table in done:
        part = table.select(key)
        keys = part if keys is None else keys.unionByName(part)
    return df if keys is None else df.join(keys, key, "left_anti")


def only(df, keys, key="id"):
    """Rows whose key occurs in the other table (key membership)."""
    return df.join(keys.select(key), key, "left_semi")


def complete(df, columns=None):
    """Rows without a null in any of the columns."""
    return df.na.drop(subset=list(columns or WORKING_COLUMNS))


class NothingToDo(Exception):
    """Raised when a step that needs rows gets none."""


def require_rows(df, what="rows"):
    """The table itself, or ``NothingToDo`` when it is empty."""
    if df.isEmpty():
        raise NothingToDo(f"no {what} left to process")
    return df


def well_located(df, limit=40000, column="public_positional_accuracy"):
    """Rows at least as accurate as the limit in metres; null fails."""
    return df.where(F.col(column) <= limit)


def differs(column, value):
    """Inequality that keeps nulls."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def overwrite_where(df, column, condition, value):
    """Set a column where a condition holds."""
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def flag_poor_quality(df, column="description", words=None, whole_words=False):
    """Add ``is_bad``; one pass, the split is a filter on this column."""
    return df.withColumn("is_bad", mentions(column, words or POOR_QUALITY_WORDS, whole_words))


def split_quality(df, column="description", words=None, whole_words=False):
    """(good, bad): bad rows are tagged and belong to the quarantine."""
    flagged = flag_poor_quality(df, column, words, whole_words)
    good = flagged.where(~F.col("is_bad")).drop("is_bad")
    bad = flagged.where("is_bad").drop("is_bad").withColumn("image_quality", F.lit("bad"))
    return good, bad


def quarantine(bad, key="id"):
    """Quarantine table: key, image address, verdict."""
    return bad.select(key, "image_url", "image_quality")


def valid_dates(df, column="observed_on"):
    """Parse ``yyyy-MM-dd``; rows that do not parse are dropped."""
    return df.withColumn(column, times.strict_date(column)).where(F.col(column).isNotNull())


def with_local_time(df, time="time_observed_at", zone="time_zone"):
    """Add the local time text of each row's own zone."""
    return df.withColumn("local_time_observed_at", times.local_time_text(times.instant(time), zone))


def interim(df, key="id"):
    """Columns of the clean table."""
    return df.select(key, *INTERIM_COLUMNS)


def batches(df, order, size=1000, name="batch"):
    """Number the rows' batches of ``size`` in the given order, from 1."""
    from .ranks import exact_rank

    ranked = exact_rank(df, order, name="_rank")
    return ranked.withColumn(name, F.ceil(F.col("_rank") / size).cast("long")).drop("_rank")
