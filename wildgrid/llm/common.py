"""Helpers shared by the operators of this subpackage."""

from contextlib import contextmanager

from pyspark.sql import functions as F

# Rows handed to a Python worker at once: bounds its memory when texts are long.
ROWS_AT_ONCE = 256


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark, rows=ROWS_AT_ONCE):
    """Hand Python workers few rows at a time, since one text can be megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting, "10000")) > rows:
        spark.conf.set(setting, str(rows))
    return spark


@contextmanager
def batches_of(spark, rows):
    """Like ``bounded_batches`` for what is run inside the block; the caller's setting comes back.

    The value is a function that sets another number of rows inside the block.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    use = lambda n: spark.conf.set(setting, str(n))
    use(rows)
    try:
        yield use
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def raw_text(text="text"):
    """The UTF-8 bytes of a text; a null text is an empty one."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit("").cast("binary"))


def held_out(doc_id="doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def pick_bounded(rows, size, limit, ids, seed):
    """About ``limit`` of ``size`` rows by a hash of their ids; never far above it.

    The share kept is 90 % of limit / size, so the count stays below the limit
    but for deviations of chance; with size <= limit all rows stay.
    """
    if size <= limit:
        return rows
    key = F.xxhash64(F.lit(seed), *[F.col(i).cast("string") for i in ids])
    return rows.where(F.pmod(key, F.lit(1 << 30)) < F.lit(int((1 << 30) * 0.9 * limit / size)))


def bind(value, use):
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]
