"""Location clusters: fits with restarts, choice of k, dispersion measures.

Points are aggregated to distinct coordinates with a weight before any fit;
the objective is the same and repeated places cost one row.
"""

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from ..functions.geo import squared_distance
from ..functions.hashing import hash_unit
from .features import fit_scaler, standardise
from .kmeans import fit_all, silhouettes
from .quantiles import union_all
from .storage import settle


def distinct_points(df, columns=("latitude", "longitude")):
    """(x0, x1, ..., n) per distinct place."""
    named = df.na.drop(subset=list(columns)).select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    points = named.groupBy(*named.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return settle(points, "points")


def axes(points):
    return [c for c in points.columns if c.startswith("x")]


def fit_kmeans(points, k, restarts=10, seed=1, max_iter=50):
    """The cheapest of several fits on weighted points."""
    return fit_all(points, [k], restarts, seed, max_iter)[0][k]


def dispersion(points, k, restarts=10, seed=1):
    """Squared error of the best fit; for one cluster the spread around the mean."""
    return fit_kmeans(points, k, restarts, seed).cost


def elbow(spark, points, ks, **options):
    """(k, cost): squared error within the clusters per k, all fitted together."""
    fits = fit_all(points, ks, **options)[0]
    return spark.createDataFrame([(int(k), fits[k].cost) for k in ks], "k int, cost double")


def within_cost(df, columns, centroids, cluster="cluster"):
    """Squared error of a given assignment, from the centroids' literal table."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
    centre = F.get(table, F.col(cluster))
    d = squared_distance(columns, [F.get(centre, F.lit(i)) for i in range(len(columns))])
    return df.groupBy(cluster).agg(F.sum(d).alias("cost"), F.count(F.lit(1)).alias("n"))


def density(df, cluster="location_cluster"):
    """Rows per cluster."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def silhouette(df, x, cluster, weight=None):
    """Mean silhouette by squared distances over all points, nothing sampled.

    Linear in the rows: the mean squared distance from a point to a cluster is
    |x|^2 - 2 x.m + q, with the mean m and the mean square q of the cluster
    (times n / (n - 1) for its own cluster). One aggregation per cluster, then
    one pass over the points beside the table of clusters. ``x``: array column.
    """
    n = F.col(weight) if weight else F.lit(1.0)
    points = df.select(F.col(x).cast("array<double>").alias("x"), F.col(cluster).alias("c"), n.cast("double").alias("n"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    cells = points.select("c", "n", F.posexplode("x").alias("i", "v"))
    means = cells.groupBy("c", "i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    means = means.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    sizes = points.groupBy("c").agg(F.sum("n").alias("size"), (F.sum(F.col("n") * square) / F.sum("n")).alias("q"))
    # One row for each cluster: the caller's number of them, gathered to one row.
    table = settle(means.join(sizes, "c").select("c", F.transform("m", lambda e: e["m"]).alias("m"), "size", "q")
                   .agg(F.collect_list(F.struct("c", "m", "size", "q")).alias("clusters")), "clusters")
    seen = points.withColumn("clusters", table.scalar()).withColumn("square", square)

    def distance(k):
        dot = F.aggregate(F.zip_with("x", k["m"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(F.lit(0.0), F.col("square") - 2 * dot + k["q"])

    mine = F.filter("clusters", lambda k: k["c"] == F.col("c"))[0]
    other = F.array_min(F.transform(F.filter("clusters", lambda k: k["c"] != F.col("c")), distance))
    seen = seen.select("n", mine["size"].alias("size"), other.alias("b"),
                       (distance(mine) * F.try_divide(mine["size"], mine["size"] - 1)).alias("a"))
    s = F.when((F.col("size") <= 1) | F.col("b").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return seen.agg((F.sum(s * F.col("n")) / F.sum("n")).alias("silhouette"))


def choose_k(points, ks=range(4, 61, 2), restarts=10, seed=1):
    """Fit every k below the number of points and keep the best silhouette.

    Returns (Clusters, [(k, score)]); the first of equal scores wins. The measure
    is the squared one for any number of points. All values of k and all
    restarts are fitted in the same passes.
    """
    size = points.count()
    ks = [int(k) for k in ks if k < size]
    if not ks:
        raise ValueError("fewer distinct points than clusters")
    fits = fit_all(points, ks, restarts, seed)[0]
    scores = silhouettes(points, fits)
    best = max(ks, key=scores.get)  # max keeps the first of equal scores
    return fits[best], [(k, float(scores[k])) for k in ks]


def gap_statistic(spark, points, ks, references=3, seed=1, restarts=1, box="unit"):
    """(k, gap, own): log mean dispersion of uniform points - log dispersion of the data (``own``).

    Uniform points are as many as the rows and come from a hash of their number,
    so every retry sees the same ones. ``box``: the unit square, or the data's.
    The data and all references are fitted in the same passes.
    """
    rows = int(points.agg(F.sum("n")).first()[0])
    cols = axes(points)
    bounds = points.agg(*[f(c).alias(f"{c}{n}") for c in cols
                          for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    tables = [points.withColumn("table", F.lit(0))]
    for r in range(references):
        unit = spark.range(rows)
        for i, c in enumerate(cols):
            u = hash_unit("id", f"{seed}.{r}.{i}")
            lo, hi = (0.0, 1.0) if box == "unit" else (bounds[f"{c}lo"], bounds[f"{c}hi"])
            unit = unit.withColumn(c, F.lit(lo) + u * (hi - lo))
        tables.append(distinct_points(unit, cols).withColumn("table", F.lit(r + 1)))
    fits = fit_all(union_all(tables), ks, restarts, seed)
    out = []
    for k in ks:
        cost = [fits[r + 1][k].cost for r in range(references)]
        own = float(np.log(fits[0][k].cost))
        out.append((int(k), float(np.log(np.mean(cost)) - own), own))
    return spark.createDataFrame(out, "k int, gap double, own double")


def first_best(scores, score, parameter, order=None):
    """Row of the largest score; the smallest parameter wins a tie.

    ``order`` lists the parameter's values as they were tried: then the first
    of them wins.
    """
    place = F.col(parameter)
    if order is not None:
        place = F.array_position(F.array(*[F.lit(float(v)) for v in order]), F.col(parameter).cast("double"))
    return scores.agg(F.max_by(F.struct(*scores.columns), F.struct(
        F.col(score), -place)).alias("b")).select("b.*")


def pca_ratios(df, columns, k=None):
    """(component, ratio): explained variance of standardised columns."""
    df = df.na.drop(subset=list(columns)).select(*[F.col(c).cast("double").alias(c) for c in columns])
    scaled = standardise(df, fit_scaler(df, columns))
    wide = VectorAssembler(inputCols=list(columns), outputCol="features").transform(scaled)
    model = PCA(k=k or len(columns), inputCol="features", outputCol="components").fit(
        wide.select("features"))
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double")
