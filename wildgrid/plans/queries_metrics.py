"""Queries: reports of truth against prediction."""

from pyspark.sql import functions as F

from ..operators import metrics
from .adapter import SQL_OBS, observations, table, with_rounded
from .catalogue import query

KINDS = ["click", "error", "purchase", "signup", "view"]
SQL_PRED = SQL_OBS + """, pr AS (
  SELECT id, label AS true_label, parent,
    CASE WHEN id % 7 < 2 THEN CASE label WHEN 'click' THEN 'view' WHEN 'error' THEN 'click'
      WHEN 'purchase' THEN 'nothing' WHEN 'signup' THEN 'error' ELSE 'view' END ELSE label END AS joint,
    CASE WHEN id % 7 < 4 THEN 'view' ELSE label END AS image,
    CASE WHEN id % 5 < 2 THEN 'error' ELSE label END AS meta FROM obs)"""


def predictions(spark, folder):
    """Three predictions per observation, wrong for some ids; one names an unseen class."""
    o, i = observations(spark, folder), F.col("id")
    wrong = F.create_map(*[F.lit(x) for p in {
        "click": "view", "error": "click", "purchase": "nothing", "signup": "error", "view": "view"}.items()
        for x in p])
    return o.select(
        "id", F.col("label").alias("true_label"), "parent",
        F.when(i % 7 < 2, F.try_element_at(wrong, F.col("label"))).otherwise(F.col("label")).alias("joint"),
        F.when(i % 7 < 4, F.lit("view")).otherwise(F.col("label")).alias("image"),
        F.when(i % 5 < 2, F.lit("error")).otherwise(F.col("label")).alias("meta"))


CELLS = ", ".join(f"count(*) FILTER (WHERE joint = '{k}') AS \"{k}\"" for k in KINDS + ["nothing"])


@query("confusion", f"""WITH {SQL_PRED} SELECT true_label AS truth, {CELLS} FROM pr GROUP BY 1""")
def confusion(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint")
    return metrics.confusion_matrix(pairs, KINDS + ["nothing"])


def sql_report(pred, zero, by="", source="pr"):
    """Report CTEs by direct counting per class."""
    g = f"{by}, " if by else ""
    same = f"AND c.{by} = x.{by}" if by else ""
    return f"""cls AS (SELECT {g}true_label AS label FROM {source} UNION SELECT {g}{pred} FROM {source}),
  cnt AS (SELECT {('c.' + by + ', ') if by else ''}c.label, count(*) FILTER (WHERE x.true_label = c.label) AS support,
      count(*) FILTER (WHERE x.{pred} = c.label) AS predicted,
      count(*) FILTER (WHERE x.{pred} = c.label AND x.true_label = c.label) AS tp
    FROM cls c JOIN {source} x ON (x.true_label = c.label OR x.{pred} = c.label) {same} GROUP BY ALL),
  prf AS (SELECT {g}label, support, CASE WHEN predicted = 0 THEN {zero} ELSE tp / predicted END AS p,
      CASE WHEN support = 0 THEN {zero} ELSE tp / support END AS r FROM cnt),
  rep AS (SELECT {g}label, p AS precision, r AS recall,
      CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1_score, support FROM prf)"""


R = "round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, round(f1_score + 1e-9, 6) AS f1_score"


@query("class_report", f"""WITH {SQL_PRED}, {sql_report('joint', '0.0::DOUBLE')} SELECT label, {R}, support FROM rep""")
def class_report(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint")
    return with_rounded(metrics.class_report(pairs), "precision", "recall", "f1_score")


@query("class_report_by_level", f"""WITH {SQL_PRED}, {sql_report('joint', '1.0::DOUBLE', 'parent')}
  SELECT parent, label, {R}, support FROM rep WHERE support <> 0""")
def class_report_by_level(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint", "parent")
    return with_rounded(metrics.class_report(pairs, "parent", 1.0, with_unseen=False),
                        "precision", "recall", "f1_score")


@query("report_summary", f"""WITH {SQL_PRED}, {sql_report('joint', '0.0::DOUBLE')}
  SELECT 'accuracy' AS "row", round(sum(recall * support) / sum(support) + 1e-9, 6) AS precision,
    round(sum(recall * support) / sum(support) + 1e-9, 6) AS recall,
    round(sum(recall * support) / sum(support) + 1e-9, 6) AS f1_score, CAST(sum(support) AS BIGINT) AS support FROM rep
  UNION ALL SELECT 'macro avg' AS "row", round(avg(precision) + 1e-9, 6) AS precision, round(avg(recall) + 1e-9, 6) AS recall,
    round(avg(f1_score) + 1e-9, 6) AS f1_score, CAST(sum(support) AS BIGINT) AS support FROM rep
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support) + 1e-9, 6),
    round(sum(recall * support) / sum(support) + 1e-9, 6),
    round(sum(f1_score * support) / sum(support) + 1e-9, 6), CAST(sum(support) AS BIGINT) FROM rep""")
def report_summary(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint")
    return with_rounded(metrics.report_summary(pairs), "precision", "recall", "f1_score")


@query("balanced_accuracy", f"""WITH {SQL_PRED},
  r AS (SELECT parent, true_label, avg(CAST(joint = true_label AS INTEGER)) AS recall FROM pr GROUP BY ALL)
  SELECT parent, round(avg(recall) + 1e-9, 6) AS accuracy FROM r GROUP BY 1""")
def balanced_accuracy(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint", "parent")
    return with_rounded(metrics.balanced_accuracy(pairs, "parent"), "accuracy")


@query("plain_accuracy", f"""WITH {SQL_PRED}
  SELECT parent, round(avg(CAST(joint = true_label AS INTEGER)) + 1e-9, 6) AS accuracy FROM pr GROUP BY 1""")
def plain_accuracy(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint", "parent")
    return with_rounded(metrics.accuracy(pairs, "parent"), "accuracy")


METHODS = {"joint": "joint-classification", "image": "image-classification", "meta": "meta-classification"}
SQL_METHODS = SQL_PRED + """, lm AS (
  SELECT parent, true_label, 'joint-classification' AS method, joint AS p FROM pr
  UNION ALL SELECT parent, true_label, 'image-classification', image FROM pr
  UNION ALL SELECT parent, true_label, 'meta-classification', meta FROM pr)"""


@query("method_accuracy", f"""WITH {SQL_METHODS},
  r AS (SELECT parent, method, true_label, avg(CAST(p = true_label AS INTEGER)) AS recall FROM lm GROUP BY ALL)
  SELECT parent, method, round(avg(recall) + 1e-9, 6) AS accuracy FROM r GROUP BY ALL""")
def method_accuracy(spark, folder):
    return with_rounded(metrics.method_accuracy(predictions(spark, folder), METHODS, "parent"), "accuracy")


@query("method_accuracy_swapped", f"""WITH {SQL_METHODS},
  r AS (SELECT parent, method, p, avg(CAST(p = true_label AS INTEGER)) AS recall FROM lm GROUP BY ALL)
  SELECT parent, method, round(avg(recall) + 1e-9, 6) AS accuracy FROM r GROUP BY ALL""")
def method_accuracy_swapped(spark, folder):
    return with_rounded(metrics.method_accuracy(
        predictions(spark, folder), METHODS, "parent", swap=True), "accuracy")


def _renamed(cte, tag):
    out = cte
    for name in ("cls", "cnt", "prf", "rep"):
        out = out.replace(f"{name} AS (", f"{name}_{tag} AS (").replace(f"FROM {name} ", f"FROM {name}_{tag} ")
        out = out.replace(f"FROM {name})", f"FROM {name}_{tag})")
    return out


DIFF = ", ".join(f"round(coalesce(a.{m}, 0) - coalesce(b.{m}, 0) + 1e-9, 6) AS {m}"
                 for m in ("precision", "recall", "f1_score"))


@query("report_diff", f"""WITH {SQL_PRED}, {_renamed(sql_report('joint', '0.0::DOUBLE'), 'a')},
  {_renamed(sql_report('image', '0.0::DOUBLE'), 'b')}
  SELECT coalesce(a.label, b.label) AS label, {DIFF}, coalesce(a.support, 0) - coalesce(b.support, 0) AS support
  FROM rep_a a FULL OUTER JOIN rep_b b ON a.label = b.label""")
def report_diff(spark, folder):
    p = predictions(spark, folder)
    joint = metrics.class_report(metrics.pair_counts(p, "true_label", "joint"))
    image = metrics.class_report(metrics.pair_counts(p, "true_label", "image"))
    return with_rounded(metrics.report_difference(joint, image), "precision", "recall", "f1_score")


@query("method_difference", f"""WITH {SQL_PRED}, {_renamed(sql_report('joint', '0.0::DOUBLE', 'parent'), 'a')},
  {_renamed(sql_report('image', '0.0::DOUBLE', 'parent'), 'b')},
  ka AS (SELECT * FROM rep_a WHERE support <> 0), kb AS (SELECT * FROM rep_b WHERE support <> 0)
  SELECT coalesce(a.parent, b.parent) AS parent, coalesce(a.label, b.label) AS label, {DIFF},
    coalesce(a.support, 0) - coalesce(b.support, 0) AS support
  FROM ka a FULL OUTER JOIN kb b ON a.label = b.label AND a.parent = b.parent""")
def method_difference(spark, folder):
    d = metrics.method_difference(predictions(spark, folder), "joint", "image", "parent")
    return with_rounded(d, "precision", "recall", "f1_score")


@query("report_beside_counts", f"""WITH {SQL_PRED}, {sql_report('joint', '0.0::DOUBLE')},
  c AS (SELECT event_type, count(*) AS observations FROM events GROUP BY 1)
  SELECT label, {R}, support, observations FROM rep LEFT JOIN c ON event_type = label""")
def report_beside_counts(spark, folder):
    report = metrics.class_report(metrics.pair_counts(predictions(spark, folder), "true_label", "joint"))
    both = metrics.beside_counts(report, table(spark, folder, "events"), "event_type")
    return with_rounded(both, "precision", "recall", "f1_score")


@query("mean_scores", f"""WITH {SQL_PRED}, {sql_report('joint', '0.0::DOUBLE', 'parent')}
  SELECT parent, round(avg(precision) + 1e-9, 6) AS precision, round(avg(recall) + 1e-9, 6) AS recall,
    round(avg(f1_score) + 1e-9, 6) AS f1_score FROM rep WHERE support <> 0 GROUP BY 1""")
def mean_scores(spark, folder):
    pairs = metrics.pair_counts(predictions(spark, folder), "true_label", "joint", "parent")
    means = metrics.mean_scores(metrics.class_report(pairs, "parent", with_unseen=False),
                                ["precision", "recall", "f1_score"], "parent")
    return with_rounded(means, "precision", "recall", "f1_score")
