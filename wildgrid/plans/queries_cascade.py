"""Queries: probability vectors, joint decisions, cascade."""

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cascade, metrics, probabilities
from .adapter import (LEVELS3, SQL_TRUTH, WEIGHTS3, class_scores, customer_truth, table, with_rounded)
from .catalogue import query


@query("mean_image_probs", """
  WITH e AS (SELECT vec_id // 3 AS id, vec_id % 3 AS part, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  l AS (SELECT id, arg_min(label, part) AS label FROM e GROUP BY 1),
  c AS (SELECT id, unnest(range(64)) AS entry, unnest(x) + 1 AS v FROM e),
  m AS (SELECT id, entry, avg(v) AS v FROM c GROUP BY ALL)
  SELECT id, label, CAST(entry AS INTEGER) AS entry, round(v / sum(v) OVER (PARTITION BY id) + 1e-9, 6) AS p
  FROM m JOIN l USING (id)""")
def mean_image_probs(spark, folder):
    e = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("id"), F.char(97 + F.col("vec_id") % 3).alias("suffix"), "label",
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 1).alias("p"))
    mean = probabilities.mean_parts(e, "id", "suffix", "p", "label")
    return with_rounded(mean.select("id", "label", F.posexplode("p").alias("entry", "p")), "p")


@query("joint_decision", """
  WITH e AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: x + 1) AS m,
      list_transform(CAST(embedding AS DOUBLE[])[33:64], lambda x: x + 1) AS i,
      CASE vec_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 ELSE 0.9 END::DOUBLE AS w FROM embeddings),
  j AS (SELECT *, [m[k] * w + i[k] * (1 - w) for k in range(1, 33)] AS v FROM e)
  SELECT id, 'c' || (list_position(v, list_max(v)) - 1) AS joint_prediction,
    'c' || (list_position(i, list_max(i)) - 1) AS image_prediction,
    'c' || (list_position(m, list_max(m)) - 1) AS meta_prediction,
    round(list_max(v) / list_sum(v) + 1e-9, 6) AS confidence FROM j""")
def joint_decision(spark, folder):
    from ..schemas import LEVELS, LEVEL_WEIGHTS

    x = F.col("embedding").cast("array<double>")
    levels = F.array(*[F.lit(n) for n in LEVELS])
    e = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.get(levels, (F.col("vec_id") % 4).cast("int")).alias("level"),
        F.array(*[F.lit(f"c{i}") for i in range(32)]).alias("classes"),
        F.transform(F.slice(x, 1, 32), lambda v: v + 1).alias("meta"),
        F.transform(F.slice(x, 33, 32), lambda v: v + 1).alias("image"))
    d = probabilities.joint_decisions(e, LEVEL_WEIGHTS).withColumn("confidence", F.array_max("joint"))
    return with_rounded(d.select("id", "joint_prediction", "image_prediction", "meta_prediction", "confidence"),
                        "confidence")


@query("hierarchy_edges", f"""WITH {SQL_TRUTH.split(' steps AS')[0].rstrip().rstrip(',')}
  SELECT CASE lvl WHEN 1 THEN 'r_name' WHEN 2 THEN 'n_name' ELSE 'c_mktsegment' END AS level, node AS parent,
    cls AS child, CAST(ordinal AS INTEGER) AS ordinal FROM edges""")
def hierarchy_edges(spark, folder):
    return cascade.hierarchy_edges(customer_truth(spark, folder), LEVELS3)


def _cascade(spark, folder, **options):
    from ..operators.storage import settle

    truth = settle(customer_truth(spark, folder), "truth")
    edges = settle(cascade.hierarchy_edges(truth, LEVELS3), "edges")
    scores = class_scores(truth, edges)
    return cascade.cascade(scores, truth, edges, LEVELS3, WEIGHTS3, **options)


@query("cascade_results", f"WITH {SQL_TRUTH} SELECT * FROM results")
def cascade_results(spark, folder):
    return _cascade(spark, folder)


@query("score_stream", f"WITH {SQL_TRUTH} SELECT * FROM results")
def score_stream(spark, folder):
    """The same cascade as a stream over landed observations, started twice."""
    from ..operators.storage import settle
    from ..streaming.ingest import stream_scoring
    from .queries_clean import _scratch

    root = _scratch(spark)
    truth = customer_truth(spark, folder)
    truth.write.parquet(f"{root}/landed")
    edges = settle(cascade.hierarchy_edges(truth, LEVELS3), "edges")

    def score(batch):
        return cascade.cascade(class_scores(batch, edges), batch, edges, LEVELS3, WEIGHTS3)

    for name in ("first", "second"):
        stream_scoring(spark, f"{root}/landed", truth.schema, f"{root}/out", f"{root}/{name}",
                       score).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("cascade_error_rate", f"""WITH {SQL_TRUTH}
  SELECT count(*) FILTER (WHERE joint_prediction <> true_label) AS errors, count(DISTINCT id) AS observations,
    round(count(*) FILTER (WHERE joint_prediction <> true_label) / count(DISTINCT id) + 1e-9, 6) AS error_rate
  FROM results""")
def cascade_error_rate(spark, folder):
    return with_rounded(metrics.cascade_error_rate(_cascade(spark, folder)), "error_rate")


@query("cascade_error_rate_upper", f"""WITH {SQL_TRUTH}
  SELECT count(*) FILTER (WHERE joint_prediction <> true_label) AS errors, count(DISTINCT id) AS observations,
    round(count(*) FILTER (WHERE joint_prediction <> true_label) / count(DISTINCT id) + 1e-9, 6) AS error_rate
  FROM results WHERE taxonomic_level <> 'c_mktsegment'""")
def cascade_error_rate_upper(spark, folder):
    return with_rounded(metrics.cascade_error_rate(_cascade(spark, folder), "c_mktsegment"), "error_rate")


@query("cascade_accuracy", f"""WITH {SQL_TRUTH},
  lm AS (SELECT taxonomic_level, true_label, 'joint' AS method, joint_prediction AS p FROM results
    UNION ALL SELECT taxonomic_level, true_label, 'image', image_prediction FROM results
    UNION ALL SELECT taxonomic_level, true_label, 'meta', meta_prediction FROM results),
  r AS (SELECT taxonomic_level, method, true_label, avg(CAST(p = true_label AS INTEGER)) AS recall FROM lm GROUP BY ALL)
  SELECT taxonomic_level, method, round(avg(recall) + 1e-9, 6) AS accuracy FROM r GROUP BY ALL""")
def cascade_accuracy(spark, folder):
    methods = {"joint_prediction": "joint", "image_prediction": "image", "meta_prediction": "meta"}
    return with_rounded(metrics.method_accuracy(_cascade(spark, folder), methods), "accuracy")


@query("vector_normalised", """
  WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 1) AS v FROM embeddings)
  SELECT vec_id, round(v[1] / list_sum(v) + 1e-9, 6) AS first,
    CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best FROM v""")
def vector_normalised(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x + 1).alias("v"))
    return with_rounded(e.select("vec_id", F.get(vectors.normalise("v"), F.lit(0)).alias("first"),
                                 vectors.first_max("v").alias("best")), "first")
