"""Arithmetic on ``array<double>`` probability vectors, inside code generation."""

from pyspark.sql import functions as F

from .geo import squared_distance
from .text import _col


def total(v):
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def normalise(v):
    """Scale a vector so that it sums to 1; null when its sum is 0."""
    v = _col(v)
    s = total(v)
    return F.when(s != 0, F.transform(v, lambda x: x / s))


def blend(meta, image, weight):
    """Weighted sum of two vectors, scaled to sum to 1."""
    w = _col(weight)
    return normalise(F.zip_with(_col(meta), _col(image), lambda m, i: m * w + i * (1 - w)))


def first_max(v):
    """0-based position of the largest value; the first one wins a tie."""
    v = _col(v)
    return F.array_position(v, F.array_max(v)) - 1


def pick(names, v):
    """Name at the position of the largest value."""
    return F.get(_col(names), first_max(v).cast("int"))


def at_position(values, position):
    """Element at a 1-based position as ``array_position`` gives it; 0 gives null."""
    return F.get(_col(values), _col(position).cast("int") - 1)


def nearest(point, centroids):
    """0-based number of the closest centroid; the lowest number wins a tie.

    ``centroids`` is a driver-side list, as a fitted model holds it: one array
    literal in the plan instead of a join with every centroid.
    """
    choices = [
        F.struct(squared_distance(point, [F.lit(float(b)) for b in centre]).alias("d"),
                 F.lit(number).alias("k"))
        for number, centre in enumerate(centroids)
    ]
    return F.array_min(F.array(*choices)).getField("k")
