"""Targets that are written together: the rows of a batch appear in all of them or in none.

Below a root each target is a Parquet table of which every batch adds one folder,
``<root>/<target>/commit=<name>``. A batch counts once its name stands in
``<root>/commits``, as a file with the next number, put there by one rename that
fails if the number is taken. ``read`` keeps the rows of names that stand there,
so what a failed batch left behind is never seen, and two writers cannot both
take the same number: the later one checks its keys again.
"""

import uuid

from pyspark.sql import functions as F, types as T

from .sinks import exists, new_rows

COMMIT = "commit"
COMMITS = "commits"


def committed(spark, root):
    """(commit): the names of all finished batches, one row each."""
    path = f"{root}/{COMMITS}"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{COMMIT} string")
    return spark.read.schema(f"{COMMIT} string").text(path)


def read(spark, root, name, schema=None):
    """The finished rows of a target; with a schema, an empty table before the first batch."""
    path = f"{root}/{name}"
    reader = spark.read
    if schema is not None:
        if not exists(spark, path):
            return spark.createDataFrame([], schema)
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())]))
    rows = reader.parquet(path)
    return rows.join(committed(spark, root), COMMIT, "left_semi").select(*[f"`{c}`" for c in rows.columns if c != COMMIT])


def commit_together(spark, root, frames, attempts=5):
    """Append one row for each new key to every target, all in one commit.

    ``frames``: {target: (rows, key)}. Keys are compared with the finished rows of
    the same target; rows without a key are always appended. Returns the number
    of the commit. If another writer finishes first, keys are compared again
    and the rows written anew, up to ``attempts`` times.
    """
    for name, (rows, _) in frames.items():
        if name == COMMITS or COMMIT in rows.columns:
            raise ValueError(f"{COMMITS!r} cannot be a target, nor {COMMIT!r} a column: {name}")
    for _ in range(attempts):
        number = _next_number(spark, root)
        mark = f"c-{uuid.uuid4().hex}"  # the letter keeps it a string for partition discovery
        for name, (rows, key) in frames.items():
            done = read(spark, root, name, rows.schema).select(key)
            new_rows(rows, done, key).write.parquet(f"{root}/{name}/{COMMIT}={mark}")
        if _publish(spark, root, number, mark):
            return number
    raise RuntimeError(f"other writers finished {attempts} commits first below {root}")


def _place(spark, path):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _next_number(spark, root):
    """One more than the largest number taken."""
    folder = _place(spark, f"{root}/{COMMITS}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    numbers = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in numbers if n.isdigit()), default=0) + 1


def _publish(spark, root, number, mark):
    """Put the name of a batch in the list under its number; False if the number is taken."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # Readers skip names with an underscore, so a half-written file is not seen.
    draft, place = _place(spark, f"{root}/{COMMITS}/_{mark}"), _place(spark, f"{root}/{COMMITS}/{number:012d}")
    fs = draft.getFileSystem(conf)
    out = fs.create(draft, False)
    try:
        out.write(bytearray(mark, "ascii"))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(place),
                     gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        taken = getattr(error, "java_exception", None)
        if taken is None or "FileAlreadyExists" not in taken.getClass().getName():
            raise
        fs.delete(draft, False)
        return False
    return True
