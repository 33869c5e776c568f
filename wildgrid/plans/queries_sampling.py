"""Queries: splits, folds, samples, balancing."""

from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.clean import only, without
from .adapter import SQL_OBS, observations, table, with_rounded
from .catalogue import query


def md5_sql(key, seed):
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


@query("stratified_holdout", f"""
  WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {md5_sql('doc_id', 2)}) AS rn,
    count(*) OVER (PARTITION BY quality) AS n FROM labels)
  SELECT doc_id, quality, rn <= round_even(0.2 * n, 0) AS is_holdout FROM r""")
def stratified_holdout(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return sampling.stratified_split(labels, "quality", "doc_id")


@query("stratified_holdout_nulls", f"""
  WITH r AS (SELECT event_id, nullif(event_type, 'view') AS label FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_sql('event_id', 7)}) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM r)
  SELECT event_id, label, label IS NOT NULL AND rn <= round_even(0.2 * n, 0) AS is_holdout FROM k""")
def stratified_holdout_nulls(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"))
    return sampling.stratified_split(e, "label", "event_id", seed=7)


@query("stratified_folds", f"""
  SELECT event_id, event_type, CAST(ntile(5) OVER (PARTITION BY event_type ORDER BY {md5_sql('event_id', 2)}) - 1
    AS INTEGER) AS fold FROM events""")
def stratified_folds(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    return sampling.stratified_folds(e, "event_type", "event_id")


@query("ordered_folds", """
  SELECT event_id, CAST(ntile(5) OVER (ORDER BY event_id) - 1 AS INTEGER) AS fold FROM events""")
def ordered_folds(spark, folder):
    return sampling.ordered_folds(table(spark, folder, "events").select("event_id"), ["event_id"])


@query("random_sample", f"""
  WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {md5_sql('doc_id', 1)}) AS rn,
    count(*) OVER () AS n FROM documents)
  SELECT doc_id, lang FROM r WHERE rn <= round_even(0.05 * n, 0)""")
def random_sample(spark, folder):
    return sampling.random_sample(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")


@query("hash_split", f"""
  SELECT event_id, CASE WHEN CAST('0x' || substr({md5_sql('event_id', 35)}, 1, 8) AS BIGINT) % 100 < 70
    THEN 'train' ELSE 'test' END AS part FROM events""")
def hash_split(spark, folder):
    return sampling.hash_split(table(spark, folder, "events").select("event_id"), "event_id")


@query("split_by_id_list", """
  SELECT o_orderkey, EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey) AS is_validation FROM orders""")
def split_by_id_list(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return only(o, ids, "o_orderkey").withColumn("is_validation", F.lit(True)).unionByName(
        without(o, ids, key="o_orderkey").withColumn("is_validation", F.lit(False)))


OVERSAMPLE = f"""
  WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
  b AS (SELECT arg_min(quality, (n, quality)) AS small, min(n) AS few, max(n) AS many FROM s),
  p AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id) AS place FROM labels, b WHERE quality = small),
  d AS (SELECT i AS copy, CAST('0x' || substr({md5_sql('i', 2)}, 1, 12) AS BIGINT) % few + 1 AS place
        FROM b, unnest(range(1, many - few + 1)) t(i))"""


@query("oversample_rows", OVERSAMPLE + """
  SELECT doc_id, quality, toxic, CAST(0 AS BIGINT) AS copy FROM labels
  UNION ALL SELECT doc_id, quality, toxic, copy FROM d JOIN p USING (place)""")
def oversample_rows(spark, folder):
    return sampling.oversample_smallest(table(spark, folder, "labels"), "quality", "doc_id")


@query("oversample_counts", f"""
  WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
  SELECT event_type, CASE WHEN n = (SELECT min(n) FROM s) THEN (SELECT max(n) FROM s) ELSE n END AS n FROM s""")
def oversample_counts(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    more = sampling.oversample_smallest(e, "event_type", "event_id")
    return more.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("balanced_weights", """
  WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
  SELECT quality, n, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n) + 1e-9, 6) AS weight FROM s""")
def balanced_weights(spark, folder):
    return with_rounded(sampling.balanced_weights(table(spark, folder, "labels"), "quality"), "weight")


@query("row_weights", f"""WITH {SQL_OBS}, s AS (SELECT label, count(*) AS n FROM obs GROUP BY 1)
  SELECT id, label, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n) + 1e-9, 6) AS weight
  FROM obs JOIN s USING (label)""")
def row_weights(spark, folder):
    o = observations(spark, folder).select("id", "label")
    return with_rounded(sampling.with_class_weight(o, "label"), "weight")
