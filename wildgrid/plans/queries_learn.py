"""Queries: node table, clusters, tuning, sweeps, on inputs whose best fit SQL can tell."""

from pyspark.sql import functions as F

from ..operators import cascade, cluster, train
from ..operators.metrics import balanced_accuracy, class_report, pair_counts
from ..operators.ranks import exact_rank
from ..operators.storage import settle
from .adapter import observations, table, with_rounded
from .catalogue import query


@query("node_table", """
  WITH p AS (SELECT p_type AS a, CASE WHEN p_size % 9 <> 0 THEN p_brand END AS b, p_name AS c,
      (p_partkey * 7919) % 60000 AS acc, p_size > 3 AS named FROM part),
  k AS (SELECT 'a' AS level, 'b' AS target, a AS parent, b AS child, count(*) FILTER (WHERE acc <= 40000 AND named) AS n
        FROM p GROUP BY ALL
    UNION ALL SELECT 'b', 'c', b, c, count(*) FILTER (WHERE acc <= 40000 AND named) FROM p WHERE b IS NOT NULL GROUP BY ALL)
  SELECT level, target, parent, count(*) FILTER (WHERE n >= 5 AND child IS NOT NULL) AS classes FROM k GROUP BY ALL
  HAVING count(*) FILTER (WHERE n >= 5 AND child IS NOT NULL) >= 2""")
def node_table(spark, folder):
    p = table(spark, folder, "part").select(
        F.col("p_type").alias("a"), F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("b"),
        F.col("p_name").alias("c"), F.when(F.col("p_size") > 3, F.col("p_name")).alias("common_name"),
        ((F.col("p_partkey") * 7919) % 60000).alias("public_positional_accuracy"))
    return train.node_table(p, ["a", "b", "c"])


SHIFT = 8  # far more than the entries of a vector differ


def vectors_as_columns(spark, folder, rule="both"):
    """embeddings as rows with an id, a label path and all 64 entries as features.

    The entries are moved so that the label is a rule of them: ``family`` moves
    all by the parity of the label, ``genus`` gives each entry another order of
    the labels, ``both`` does the one for the first half and the other for the rest.
    """
    e = table(spark, folder, "embeddings")
    names = [f"f{i}" for i in range(64)]

    def moved(i):
        by_family = rule == "family" or (rule == "both" and i < 32)
        step = F.col("label") % 2 if by_family else (F.col("label") + i) % 10
        return (F.get("embedding", F.lit(i)).cast("double") + SHIFT * step).alias(f"f{i}")

    return e.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("F"), F.col("label") % 2).alias("family"),
        F.concat(F.lit("G"), F.col("label")).alias("genus"),
        F.lit("x").alias("common_name"), F.lit(10.0).alias("public_positional_accuracy"),
        *[moved(i) for i in range(64)]), names


def far_groups(spark, folder):
    """events as points in groups far apart, one group per event type."""
    e = table(spark, folder, "events").select("event_id", "event_type")
    kinds = e.select("event_type").distinct()
    numbered = exact_rank(kinds, "event_type", name="g")
    return e.join(numbered, "event_type").select(
        (F.col("g") * 1000 + (F.col("event_id") % 7) / 8).alias("latitude"),
        (F.col("g") * -500 + (F.col("event_id") % 11) / 8).alias("longitude"))


SQL_GROUPS = """t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS g
    FROM (SELECT DISTINCT event_type FROM events)),
  p AS (SELECT g, g * 1000 + (event_id % 7) / 8.0::DOUBLE AS a, g * -500 + (event_id % 11) / 8.0::DOUBLE AS b
    FROM events JOIN t USING (event_type)),
  w AS (SELECT g, sum((a - ma) ** 2 + (b - mb) ** 2) AS cost
    FROM p JOIN (SELECT g, avg(a) AS ma, avg(b) AS mb FROM p GROUP BY g) USING (g) GROUP BY g)"""


def _group_count(spark, folder):
    return table(spark, folder, "events").select("event_type").distinct().count()


@query("kmeans_best_k", f"""WITH {SQL_GROUPS}
  SELECT CAST(count(*) AS INTEGER) AS k, round(sum(cost) + 1e-6, 3) AS cost FROM w""")
def kmeans_best_k(spark, folder):
    """The number of groups, and the cost of the fit with it, from all values tried."""
    n = _group_count(spark, folder)
    points = cluster.distinct_points(far_groups(spark, folder))
    model, _ = cluster.choose_k(points, ks=[max(2, n - 2), n, n + 3], restarts=3)
    found = spark.createDataFrame([(model.k, model.cost)], "k int, cost double")
    return with_rounded(found, "cost", digits=3)


def nested_groups(spark, folder):
    """events as points in 12 groups: 3 far apart, of 2 pairs each, so the best 3, 6 and 12 clusters are known."""
    return table(spark, folder, "events").select(
        (F.floor(F.col("event_id") % 12 / 4) * 1000000 + F.floor(F.col("event_id") % 4 / 2) * 10000
         + F.col("event_id") % 2 * 100 + F.floor(F.col("event_id") / 12) % 7 / 8).alias("latitude"),
        (F.floor(F.col("event_id") / 84) % 5 / 8).alias("longitude"))


SQL_NESTED = """e AS (SELECT event_id % 12 AS g, event_id // 12 % 7 / 8.0::DOUBLE AS u, event_id // 84 % 5 / 8.0::DOUBLE AS b
    FROM events),
  p AS (SELECT g, (g // 4) * 1000000 + (g % 4 // 2) * 10000 + g % 2 * 100 + u AS a, b FROM e),
  q AS (SELECT k, CASE k WHEN 3 THEN g // 4 WHEN 6 THEN g // 2 ELSE g END AS c, a, b
    FROM p, (SELECT unnest([3, 6, 12]) AS k)),
  m AS (SELECT k, c, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) + var_pop(b) AS v FROM q GROUP BY k, c),
  w AS (SELECT k, sum(n * v) AS cost FROM m GROUP BY k),
  d AS (SELECT q.k, q.c, q.a, q.b, min(CASE WHEN m.c = q.c THEN ((q.a - ma) ** 2 + (q.b - mb) ** 2 + v) * n / (n - 1) END) AS own,
      min(CASE WHEN m.c <> q.c THEN (q.a - ma) ** 2 + (q.b - mb) ** 2 + v END) AS other
    FROM (SELECT DISTINCT k, c, a, b FROM q) q JOIN m ON m.k = q.k GROUP BY q.k, q.c, q.a, q.b),
  s AS (SELECT k, avg((other - own) / greatest(other, own)) AS silhouette FROM q JOIN d USING (k, c, a, b) GROUP BY k)"""


@query("kmeans_scores", f"""WITH {SQL_NESTED}
  SELECT CAST(k AS INTEGER) AS k, round(silhouette + 1e-9, 6) AS silhouette, silhouette = max(silhouette) OVER () AS best FROM s""")
def kmeans_scores(spark, folder):
    """The silhouette of every k tried, and which of them is taken."""
    points = cluster.distinct_points(nested_groups(spark, folder))
    model, scores = cluster.choose_k(points, ks=[3, 6, 12], restarts=4)
    found = spark.createDataFrame([(k, s, k == model.k) for k, s in scores], "k int, silhouette double, best boolean")
    return with_rounded(found, "silhouette")


@query("gap_curve", f"""WITH {SQL_NESTED},
  one AS (SELECT 1 AS k, count(*) * (var_pop(a) + var_pop(b)) AS cost FROM p UNION ALL SELECT k, cost FROM w)
  SELECT CAST(k AS INTEGER) AS k, round(ln(cost) + 1e-9, 5) AS own, k = 12 AS widest FROM one""")
def gap_curve(spark, folder):
    """Log dispersion of the data for every k, and the k with the widest gap to uniform points."""
    points = cluster.distinct_points(nested_groups(spark, folder))
    gaps = cluster.gap_statistic(spark, points, [1, 3, 6, 12], references=2, restarts=4, box="data")
    best = cluster.first_best(gaps, "gap", "k").first()["k"]
    return with_rounded(gaps.select("k", "own", (F.col("k") == best).alias("widest")), "own", digits=5)


@query("elbow_one_cluster", """
  WITH o AS (SELECT CAST((event_id * 37) % 181 - 90 AS DOUBLE) AS a, CAST((event_id * 53) % 361 - 180 AS DOUBLE) AS b
             FROM events)
  SELECT CAST(1 AS INTEGER) AS k, round(sum(a * a) - sum(a) ** 2 / count(*) + sum(b * b) - sum(b) ** 2 / count(*)
    + 1e-5, 2) AS cost FROM o""")
def elbow_one_cluster(spark, folder):
    points = cluster.distinct_points(observations(spark, folder))
    return with_rounded(cluster.elbow(spark, points, [1]), "cost", digits=2)


@query("elbow_curve", f"""WITH {SQL_GROUPS}
  SELECT CAST(1 AS INTEGER) AS k, round((SELECT sum(a * a) - sum(a) ** 2 / count(*) + sum(b * b) - sum(b) ** 2 / count(*)
    FROM p) / 1e6 + 1e-6, 3) AS cost
  UNION ALL SELECT CAST(count(*) AS INTEGER), round(sum(cost) / 1e6 + 1e-6, 3) FROM w""")
def elbow_curve(spark, folder):
    """Squared error in millions, of one cluster and of one for each group."""
    points = cluster.distinct_points(far_groups(spark, folder))
    curve = cluster.elbow(spark, points, [1, _group_count(spark, folder)], restarts=3)
    return with_rounded(curve.withColumn("cost", F.col("cost") / 1e6), "cost", digits=3)


@query("gap_statistic", "SELECT CAST(count(DISTINCT event_type) AS INTEGER) AS k FROM events")
def gap_statistic(spark, folder):
    """The number of clusters with the widest gap to uniform points."""
    n = _group_count(spark, folder)
    points = cluster.distinct_points(far_groups(spark, folder))
    gaps = cluster.gap_statistic(spark, points, [1, max(2, n - 2), n], references=2, restarts=2, box="data")
    return cluster.first_best(gaps, "gap", "k").select("k")


@query("pca_two_columns", """
  WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
  SELECT CAST(1 AS INTEGER) AS component, round((1 + r) / 2 + 1e-9, 6) AS ratio FROM c
  UNION ALL SELECT 2, round((1 - r) / 2 + 1e-9, 6) FROM c""")
def pca_two_columns(spark, folder):
    """Two standardised columns: the shares follow from their correlation."""
    li = table(spark, folder, "lineitem")
    return with_rounded(cluster.pca_ratios(li, ["l_quantity", "l_extendedprice"]), "ratio")


FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL_SQUARES = " + ".join(f"2 * corr({a}, {b}) ** 2" for i, a in enumerate(FOUR) for b in FOUR[:i])


@query("pca_ratio", f"""
  SELECT round(1.0::DOUBLE + 1e-9, 6) AS total, round((4 + {SQL_SQUARES}) / 16 + 1e-9, 6) AS squares FROM lineitem""")
def pca_ratio(spark, folder):
    """Four columns: the shares sum to 1, and their squares to those of the correlations."""
    ratios = cluster.pca_ratios(table(spark, folder, "lineitem"), FOUR)
    return with_rounded(ratios.agg(F.sum("ratio").alias("total"), F.sum(F.col("ratio") ** 2).alias("squares")),
                        "total", "squares")


SQL_GENUS = "SELECT vec_id AS id, 'G' || label AS predicted, 1.0::DOUBLE AS best_score FROM embeddings"
SQL_FAMILY = "SELECT vec_id AS id, 'F' || (label % 2) AS predicted, 1.0::DOUBLE AS best_score FROM embeddings"


def _tuned(spark, folder, kind, target, grid, k=2, **options):
    """Predictions of the refitted model for all rows, with the best mean score."""
    df, names = vectors_as_columns(spark, folder, target)
    df = settle(df, "tuned")
    model, scores, _ = train.tune(df, kind, target, names, grid, k=k, **options)
    best = scores.agg(F.max("mean_score").alias("best_score")).first()["best_score"]
    return model.transform(df).select("id", "predicted", F.lit(float(best)).alias("best_score"))


@query("tune_tree", SQL_GENUS)
def tune_tree(spark, folder):
    return _tuned(spark, folder, "tree", "genus", [2, 9])


@query("tune_forest", SQL_GENUS)
def tune_forest(spark, folder):
    return _tuned(spark, folder, "forest", "genus", [1, 9], trees=10)


@query("tune_boosted", SQL_GENUS)
def tune_boosted(spark, folder):
    """Ten classes boosted together."""
    return _tuned(spark, folder, "boosted", "genus", [1, 4], iterations=4)


@query("tune_boosted_stumps", SQL_FAMILY)
def tune_boosted_stumps(spark, folder):
    return _tuned(spark, folder, "stumps", "family", [1, 4])


@query("tune_network", SQL_GENUS)
def tune_network(spark, folder):
    """Ten classes, two learning rates and two folds in the same steps."""
    return _tuned(spark, folder, "network", "genus", [0.0001, 0.01], epochs=5, batches=8)


@query("embedding_head", """
  WITH t AS (SELECT 'G' || label AS label, CAST('0x' || substr(md5('123|' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT)
    % 100 >= 80 AS test FROM embeddings)
  SELECT label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score, count(*) AS support
  FROM t WHERE test GROUP BY label""")
def embedding_head(spark, folder):
    """One linear softmax layer on frozen image vectors, 80/20 split by hash."""
    from ..operators.sampling import hash_split

    df, names = vectors_as_columns(spark, folder, "genus")
    split = settle(hash_split(df, "id", 80, 123), "head")
    model = train.fit_node(split.where("part = 'train'"), "linear", "genus", names, 0.0)
    scored = model.transform(split.where("part = 'test'"))
    return class_report(pair_counts(scored, "genus", "predicted"), with_unseen=False)


@query("node_sweep", """
  SELECT DISTINCT 'base' AS node, 'tree' AS kind, 1.0::DOUBLE AS accuracy FROM embeddings
  UNION ALL SELECT DISTINCT 'F' || (label % 2), 'tree', 1.0::DOUBLE FROM embeddings""")
def node_sweep(spark, folder):
    """One tree per node, root included, with grouped holdout accuracy."""
    df, names = vectors_as_columns(spark, folder)
    _, predictions, _ = train.sweep(df, ["family", "genus"], names, ["tree"], grids={"tree": [9]}, k=2,
                                    root_target="family")
    return balanced_accuracy(pair_counts(predictions, "true_label", "prediction", ["node", "kind"]),
                             ["node", "kind"])


def with_gaps(df):
    """Two features are null in some rows."""
    return df.withColumn("f5", F.when(F.col("id") % 13 != 0, F.col("f5"))) \
             .withColumn("f40", F.when(F.col("id") % 17 != 0, F.col("f40")))


@query("sweep_rejects", """
  WITH e AS (SELECT vec_id AS id, 'F' || (label % 2) AS family, label,
    concat_ws(', ', CASE WHEN vec_id % 13 = 0 THEN 'f5' END, CASE WHEN vec_id % 17 = 0 THEN 'f40' END) AS missing FROM embeddings),
  n AS (SELECT *, count(*) OVER (PARTITION BY family) AS nf, count(*) OVER (PARTITION BY label) AS ng FROM e)
  SELECT 'base' AS node, 'tree' AS kind, 'family' AS level, id, 'null in ' || missing AS reason
  FROM n WHERE missing <> '' AND nf >= 5
  UNION ALL SELECT family, 'tree', 'genus', id, 'null in ' || missing FROM n WHERE missing <> '' AND ng >= 5""")
def sweep_rejects(spark, folder):
    """Rows that no model of a node could be trained or checked on."""
    df, names = vectors_as_columns(spark, folder)
    return train.sweep(with_gaps(df), ["family", "genus"], names, ["tree"], grids={"tree": [9]}, k=2,
                       root_target="family")[2]


def _models(df, names, nodes=("base", "F0", "F1")):
    meta, image = {}, {}
    for node in nodes:
        target = "family" if node == "base" else "genus"
        rows = df if node == "base" else df.where(F.col("family") == node)
        meta[node] = train.fit_node(rows, "tree", target, names, 9)
        image[node] = train.fit_node(rows, "linear", target, names, 0.0)
    return meta, image


@query("model_cascade", """
  SELECT vec_id AS id, 'family' AS taxonomic_level, 'F' || (label % 2) AS joint_prediction,
    'F' || (label % 2) AS image_prediction, 'F' || (label % 2) AS meta_prediction, 'F' || (label % 2) AS true_label
  FROM embeddings
  UNION ALL SELECT vec_id, 'genus', 'G' || label, 'G' || label, 'G' || label, 'G' || label FROM embeddings""")
def model_cascade(spark, folder):
    """Cascade with fitted models: trees as one source, linear heads as the other."""
    df, names = vectors_as_columns(spark, folder)
    df = settle(df, "cascade")
    levels = ["family", "genus"]
    edges = cascade.hierarchy_edges(df, levels)
    meta, image = _models(df, names)
    return cascade.cascade_with_models(df, edges, levels, meta, image, {"family": 0.1, "genus": 0.2})[0]


@query("cascade_rejects", """
  SELECT vec_id AS id, CASE WHEN broken THEN 'family' ELSE 'genus' END AS level,
    CASE WHEN broken THEN 'base' ELSE 'F1' END AS node,
    CASE WHEN broken THEN 'null feature' ELSE 'no model' END AS reason
  FROM (SELECT *, vec_id % 13 = 0 OR vec_id % 17 = 0 AS broken FROM embeddings) WHERE broken OR label % 2 = 1""")
def cascade_rejects(spark, folder):
    """Observations without a decision: null features at the root, no model below F1."""
    df, names = vectors_as_columns(spark, folder)
    df = settle(df, "cascade")
    levels = ["family", "genus"]
    edges = cascade.hierarchy_edges(df, levels)
    meta, image = _models(df, names, ("base", "F0"))
    return cascade.cascade_with_models(with_gaps(df), edges, levels, meta, image, {"family": 0.1, "genus": 0.2})[1]
