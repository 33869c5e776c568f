"""Intermediate results that survive the loss of an executor.

``settle`` writes a DataFrame to the folder all executors share and reads it
back. That cuts lineage, fixes anything that depends on task order, and tells
the planner the true size: a join with a settled table is broadcast only when
its files are below ``spark.sql.autoBroadcastJoinThreshold``; beyond that it is
a shuffled join whose hot partitions adaptive execution splits.
"""

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

# file:/x and file:///x are one path.
_SCHEME = re.compile("^([A-Za-z0-9+.-]+):/+")


def shared_folder(spark):
    """The folder named in ``spark.checkpoint.dir``; nothing is made up if it is unset.

    A folder with a scheme is taken as it is, ``file:`` too: it may be a mount
    that all machines share, which only the one who names it can know. A folder
    without a scheme lies on the default file system, as everywhere in Spark. If
    that is ``file:`` on a cluster, a few rows are written and read once; where
    they get lost the executors do not share the folder, and the job stops.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = spark.sparkContext.master.startswith("local")
    if local or ":" in folder.split("/")[0]:
        return folder
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    qualified = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    tried = (spark.sparkContext.applicationId, qualified)
    if qualified.startswith("file:") and tried not in _shared:
        if not returns_rows(spark, qualified):
            raise RuntimeError(f"the executors do not share spark.checkpoint.dir {folder!r}; name one they share, such as hdfs: or s3a:")
        _shared.add(tried)
    return qualified


_shared = set()  # (application, folder) that gave back all rows


def returns_rows(spark, folder):
    """Whether rows that all executors write below a folder can be read again, all of them."""
    path, n = f"{folder}/probe-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).write.parquet(path)
    found = spark.read.schema("id long").parquet(path).count()
    remove(spark, path)
    return found == n


def settle(df, name="step", partition_by=()):
    """Write once, read back; the rest of the plan starts at the written files.

    With ``partition_by`` a filter on these columns reads their folders only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for made in getattr(_own, "scopes", ()):
        made.append(path)
    back = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    back._settled_at = path
    return back


def forget(df):
    """Remove the files of a table that ``settle`` returned; nothing may read it any more."""
    remove(df.sparkSession, df._settled_at)


def remove(spark, path):
    """Remove a file or a folder with all below it, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_own = threading.local()  # streams run side by side: each removes only its own steps


@contextmanager
def steps_removed(spark):
    """Remove what ``settle`` writes inside the block, at its end.

    For jobs that write their results themselves: nothing made inside the block
    can be read after it. A failed job leaves its steps for a look at them.
    """
    made = []
    _own.scopes = [*getattr(_own, "scopes", ()), made]
    try:
        yield
        for path in made:
            remove(spark, path)
    finally:
        _own.scopes = _own.scopes[:-1]


def attach(df, small, on, how="left", name="attach"):
    """Join per-group results back to their rows.

    ``df`` is read twice, once for its groups and once here: cheap for a table
    of which few columns are needed, so settle anything longer first. The group
    table is settled, so the large side is not shuffled as long as that table is
    really small, and a hot group never meets one task.
    """
    return df.join(settle(small, name), on, how)


def scalar_of(df, expression):
    """One aggregate of a whole table as a column, evaluated inside the plan."""
    return df.agg(expression.alias("v")).select("v").scalar()


def bounded_rows(df, limit, what):
    """Collect a table that has to be small, or say that it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}; this step needs a bounded list")
    return rows


def input_order(df, paths=None):
    """Struct that sorts rows as they stood in the input files.

    Place of the file in ``paths`` (or the path itself), start of the block
    inside the file, then the row counter of the task that read the block. A
    file belongs to the longest path that is the file itself or a folder above
    it; a path with wildcards stands for the files it matches.
    """
    name = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME.pattern, "$1:/")
    place = F.lit(0)
    if paths:
        # One entry per given path: a list as long as the caller's.
        spark, known = df.sparkSession, {}
        for number, path in enumerate(paths):
            for found in _resolved(spark, str(path)):
                known.setdefault(found, number)
        above = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in known.items()])
        hits = F.filter(above, lambda e: (name == e["p"]) | F.startswith(name, F.concat(e["p"], F.lit("/"))))
        longest = F.array_max(F.transform(hits, lambda e: F.struct(F.length(e["p"]).alias("l"), e["n"].alias("n"))))
        place = F.coalesce(longest["n"], F.lit(len(paths)))
    return df.withColumn("input_order", F.struct(
        place.alias("source"), name.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def _resolved(spark, path):
    """The given path, or what it matches, written as file metadata write it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target) or []
    encoded = [jvm.org.apache.spark.paths.SparkPath.fromPath(f.getPath()).urlEncoded() for f in found]
    return [_SCHEME.sub(r"\1:/", e) for e in encoded]
