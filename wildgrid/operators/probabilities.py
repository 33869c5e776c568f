"""Probability vectors: means over sub-images, joint decisions of two sources."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions import vectors


def mean_parts(df, key, part, vector="p", label=None):
    """Mean vector over the parts of each key, scaled to sum to 1.

    One aggregation: vectors are added up before the shuffle, so a key with very
    many parts is no problem. ``label``: the label of the first part.
    """
    key = [key] if isinstance(key, str) else list(key)
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_m")
    first = [F.min_by(label, part).alias(label)] if label else []
    out = df.groupBy(*key).agg(mean, *first)
    return out.select(*key, vectors.normalise(vector_to_array("_m")).alias(vector),
                      *([label] if label else []))


def level_weight(level, weights):
    """Metadata weight of a level, from a small dictionary."""
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    return F.try_element_at(table, F.col(level))


def joint_decisions(df, weights, level="level", classes="classes", meta="meta", image="image"):
    """Joint, image and metadata decision per row, as expressions only."""
    joint = vectors.blend(meta, image, level_weight(level, weights))
    return df.withColumn("joint", joint) \
             .withColumn("joint_prediction", vectors.pick(classes, "joint")) \
             .withColumn("image_prediction", vectors.pick(classes, image)) \
             .withColumn("meta_prediction", vectors.pick(classes, meta))


def softmax(v):
    """Raw scores -> probabilities."""
    v = F.col(v) if isinstance(v, str) else v
    top = F.array_max(v)
    return vectors.normalise(F.transform(v, lambda x: F.exp(x - top)))
