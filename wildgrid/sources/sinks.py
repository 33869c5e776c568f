"""Writers. Append commits whole jobs; key-checked append makes retries harmless."""

from pyspark.sql import functions as F

from ..operators.clean import least_rows
from ..operators.storage import settle


def exists(spark, path):
    """True when a table has been written at the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def read_or_empty(spark, path, schema, fmt="parquet"):
    """The table at a path, or an empty one before the first write."""
    if exists(spark, path):
        return spark.read.format(fmt).schema(schema).load(path)
    return spark.createDataFrame([], schema)


def append(df, path, fmt="parquet", partition_by=(), **options):
    """Create or append."""
    writer = df.write.mode("append").format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_new(df, path, key, fmt="parquet"):
    """Append one row for each key that is not there yet; a second run adds nothing."""
    done = read_or_empty(df.sparkSession, path, df.schema, fmt).select(key)
    append(new_rows(df, done, key), path, fmt)


def new_rows(df, done, key):
    """One row for each key of ``df`` that is not in ``done``.

    Of several rows of a key the least is kept, so a repeated batch writes the
    same rows. Of ``done`` only keys of this batch are kept for the comparison,
    so a history is read in one narrow column and never shuffled as long as the
    batch's keys are few. Rows without a key are always kept.
    """
    keys = settle(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "batch-keys")
    seen = settle(done.join(keys.select(key), key, "left_semi").distinct(), "seen")
    fresh = df.join(seen, key, "left_anti").select(*df.columns)
    twice = keys.where("_n > 1").select(key)
    if not twice.isEmpty():
        repeated = least_rows(fresh.join(twice, key, "left_semi").select(*df.columns), key)
        fresh = fresh.join(twice, key, "left_anti").select(*df.columns).unionByName(repeated)
    return fresh


def append_report(df, path, **tags):
    """Add metric rows, each with constant tag columns, to a report table."""
    for name, value in tags.items():
        df = df.withColumn(name, F.lit(value))
    append(df, path)


def overwrite(df, path, fmt="parquet", partition_by=(), **options):
    """Replace the table. CSV gets a header and the quoting ``read_csv`` expects."""
    if fmt == "csv":
        options = {"header": True, "quote": '"', "escape": '"', **options}
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def snapshot_json(df, columns=None, name="json"):
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias(name))
