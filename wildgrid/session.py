"""Session settings the operators rely on."""

from pyspark.sql import SparkSession

# Settings that change results or plans; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(name="wildgrid", master=None, **extra):
    """A session with UTC wall clock and adaptive execution.

    ``master`` is for tests only; on a cluster it comes from spark-submit.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark):
    """Put the settings on a session that somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def with_scratch(spark):
    """For a session without ``spark.checkpoint.dir``; callers only.

    A local session gets a temporary folder. Executors of their own may not see
    one, so their steps go below the warehouse, if rows that they write there can
    be read again; else no folder is named, and what needs one stops.
    """
    import tempfile

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from .operators import storage

    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return spark
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        return spark
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"
    try:
        shared = storage.returns_rows(spark, folder)
    except (PySparkException, Py4JJavaError):
        shared = False
    if shared:
        context.setCheckpointDir(folder)
    return spark
