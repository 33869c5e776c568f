"""Saved models: one artefact per (level, node, kind) and a table that lists them."""

import hashlib
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators.kmeans import Clusters
from .sinks import append, overwrite, read_or_empty

REGISTRY = "level string, node string, kind string, path string, saved_at timestamp"


def artefact_name(node, kind, level=""):
    """Spaces to underscores, lower case, then the model kind.

    Names that fall together so (other case, an underscore for a space, the same
    name on two levels) are told apart by a few digits of their hash.
    """
    exact = hashlib.md5(f"{level}|{node}".encode()).hexdigest()[:10]
    return f"{node.replace(' ', '_').lower()}_{kind}_{exact}"


def save_model(spark, model, root, node, kind, level=""):
    """Write a fitted pipeline and register it."""
    path = f"{root}/models/{artefact_name(node, kind, level)}"
    model.write().overwrite().save(path)
    return register(spark, root, node, kind, level, path)


def register(spark, root, node, kind, level, path):
    """List a saved model."""
    row = [(level, node, kind, path, datetime.now(timezone.utc))]
    append(spark.createDataFrame(row, REGISTRY).coalesce(1), f"{root}/registry")
    return path


def registered(spark, root):
    """The newest entry of each saved model."""
    rows = read_or_empty(spark, f"{root}/registry", spark.createDataFrame([], REGISTRY).schema)
    return rows.groupBy("level", "node", "kind").agg(
        F.max_by("path", "saved_at").alias("path"), F.max("saved_at").alias("saved_at"))


def load_model(spark, root, node, kind, level=""):
    """The model of a node, found by the naming rule."""
    return PipelineModel.load(f"{root}/models/{artefact_name(node, kind, level)}")


def save_clusters(spark, clusters, root, node, level=""):
    """Save the location clusters of a node next to its classifiers, as rows (cluster, centre, cost)."""
    path = f"{root}/models/{artefact_name(node, 'k_means', level)}"
    rows = [(i, [float(v) for v in c], clusters.cost) for i, c in enumerate(clusters.clusterCenters())]
    overwrite(spark.createDataFrame(rows, "cluster int, centre array<double>, cost double").coalesce(1), path)
    return register(spark, root, node, "k_means", level, path)


def load_clusters(spark, root, node, level=""):
    rows = spark.read.parquet(f"{root}/models/{artefact_name(node, 'k_means', level)}").orderBy("cluster").collect()
    return Clusters([r["centre"] for r in rows], rows[0]["cost"])
