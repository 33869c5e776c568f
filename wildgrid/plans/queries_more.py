"""Queries: file order, listings, reports, saved models, gates, stream accounting."""

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import clean, cluster, features, train
from ..operators.storage import settle
from ..sources import readers, registry, sinks, targets
from . import modelling
from .adapter import land_weather_jobs, table, with_rounded
from .catalogue import query
from .queries_clean import _scratch
from .queries_enrich import SQL_JOBS
from .queries_learn import vectors_as_columns


@query("file_order_first", """
  WITH f AS (SELECT c_custkey, c_custkey % 70 AS key, CASE c_custkey % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'b' ELSE 'a' END AS folder
    FROM customer),
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY
    CASE folder WHEN 'ab' THEN 0 WHEN 'b' THEN 1 ELSE 2 END, c_custkey) AS n FROM f)
  SELECT key, folder, c_custkey FROM r WHERE n = 1""")
def file_order_first(spark, folder):
    """First row per key over three folders, of which one begins another's name."""
    from pyspark.sql import types as T

    root = _scratch(spark)
    c = table(spark, folder, "customer").select((F.col("c_custkey") % 70).alias("key"), "c_custkey")
    for rest, name in enumerate(("ab", "b", "a")):
        part = c.where(F.col("c_custkey") % 3 == rest).withColumn("folder", F.lit(name))
        sinks.overwrite(part.select("key", "folder", "c_custkey").orderBy("c_custkey").coalesce(1), f"{root}/{name}", "csv")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("folder", T.StringType()),
                           T.StructField("c_custkey", T.LongType())])
    rows = readers.read_csv(spark, [f"{root}/{n}" for n in ("ab", "b", "a")], schema, keep_order=True)
    return clean.dedupe_first(rows, "key").drop("input_order")


@query("append_metrics", """
  SELECT label, precision, level, kind FROM (SELECT label, CAST(count(*) AS DOUBLE) AS precision FROM embeddings GROUP BY 1),
    (SELECT 'Genus' AS level, 'tree' AS kind UNION ALL SELECT 'Species', 'network')""")
def append_metrics(spark, folder):
    """One report appended twice under different tags."""
    path = f"{_scratch(spark)}/report"
    report = table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("precision"))
    for level, kind in (("Genus", "tree"), ("Species", "network")):
        sinks.append_report(report, path, level=level, kind=kind)
    return spark.read.parquet(path)


def _listing(spark, folder):
    e = table(spark, folder, "embeddings")
    name = F.concat(F.col("vec_id").cast("string"), F.lit("_a.jpg"))
    return e.select(F.concat(F.lit("img/G"), "label", F.lit("/"), name).alias("path"), name.alias("name"),
                    F.concat(F.lit("G"), "label").alias("folder"))


@query("labelled_listing", """
  SELECT 'img/G' || label || '/' || vec_id || '_a.jpg' AS path, vec_id || '_a.jpg' AS name, 'G' || label AS label,
    CAST(dense_rank() OVER (ORDER BY 'G' || label) - 1 AS INTEGER) AS class_index FROM embeddings""")
def labelled_listing(spark, folder):
    return readers.labelled_files(_listing(spark, folder))


@query("listing_ids", "SELECT 'img/G' || label || '/' || vec_id || '_a.jpg' AS path, vec_id AS id FROM embeddings")
def listing_ids(spark, folder):
    return readers.file_ids(_listing(spark, folder))


@query("saved_model", """
  SELECT vec_id AS id, 'G' || label AS predicted, 1 AS n_registered FROM embeddings""")
def saved_model(spark, folder):
    """A model saved twice, loaded, and applied: predictions, and one registry entry."""
    df, names = vectors_as_columns(spark, folder, "genus")
    df, root = settle(df, "saved"), _scratch(spark)
    for _ in range(2):
        train.fit_node(df, "tree", "genus", names, 9).save(spark, root, "Some Node", "genus")
    again = train.NodeModel.load(spark, root, "Some Node", "tree", "genus")
    entries = registry.registered(spark, root).count()
    return again.transform(df).select("id", "predicted", F.lit(entries).alias("n_registered"))


@query("empty_guard", """
  SELECT 'all' AS what, count(*) AS n FROM orders
  UNION ALL SELECT 'none', CASE WHEN count(*) FILTER (WHERE o_orderkey < 0) = 0 THEN -1 ELSE 0 END FROM orders""")
def empty_guard(spark, folder):
    """Rows of a table that has some; -1 for a selection that has none."""
    orders = table(spark, folder, "orders")
    found = [clean.require_rows(orders).agg(F.lit("all").alias("what"), F.count(F.lit(1)).alias("n"))]
    try:
        clean.require_rows(orders.where("o_orderkey < 0"))
    except clean.NothingToDo:
        found.append(orders.agg(F.lit("none").alias("what"), (F.count(F.lit(1)) * 0 - 1).alias("n")))
    return found[0].unionByName(found[-1])


@query("features_and_label", """
  SELECT o_orderkey AS id, o_totalprice AS price, o_custkey AS customer, o_orderpriority AS label
  FROM orders WHERE o_orderstatus <> 'P'""")
def features_and_label(spark, folder):
    """Features and labels of rows with a label, split and joined again by key."""
    label = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
                                                 F.col("o_custkey").alias("customer"), label)
    x, y = features.split_xy(rows, "label", ["price", "customer"])
    return x.join(y, "id")


@query("best_parameter", """
  WITH s AS (SELECT l_linenumber AS value, count(*) // 1000 AS score FROM lineitem GROUP BY 1)
  SELECT value, score FROM s ORDER BY score DESC, value LIMIT 1""")
def best_parameter(spark, folder):
    """Parameter with the largest score, the smallest of equal ones."""
    scores = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("value")).agg(
        F.floor(F.count(F.lit(1)) / 1000).alias("score"))
    return cluster.first_best(scores, "score", "value")


@query("columns_by_pattern", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def columns_by_pattern(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(*text.columns_matching(li, "key$"))


@query("all_zones", """
  WITH z AS (SELECT event_id AS id, ts, (['CET', 'Japan', 'NZ', 'EST5EDT', 'GB', 'Nowhere/None', 'Asia/Kolkata'])[1 + event_id % 7] AS zone
    FROM events)
  SELECT id, zone, CASE WHEN zone <> 'Nowhere/None' THEN CAST(hour(timezone(CASE WHEN zone = 'Nowhere/None' THEN 'UTC' ELSE zone END,
    timezone('UTC', ts))) AS INTEGER) END AS local_hour FROM z""")
def all_zones(spark, folder):
    """Zone names without an area are zones too; unknown ones give null."""
    names = F.array(*map(F.lit, ["CET", "Japan", "NZ", "EST5EDT", "GB", "Nowhere/None", "Asia/Kolkata"]))
    e = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.get(names, (F.col("event_id") % 7).cast("int")).alias("zone"))
    return e.select("id", "zone", times.local_hour("ts", "zone").alias("local_hour"))


@query("stream_accounting", f"""WITH {SQL_JOBS}
  SELECT 'kept' AS outcome, count(*) AS n FROM jobs WHERE NOT no_hour AND NOT no_rain
  UNION ALL SELECT CASE WHEN no_hour THEN 'no such hour' ELSE 'missing reading' END, count(*) FROM jobs
    WHERE no_hour OR no_rain GROUP BY 1
  UNION ALL SELECT 'unreadable', count(*) FROM customer""")
def stream_accounting(spark, folder):
    """Every landed line, broken ones too, is a snapshot or an open reject; landed and read twice, then removed."""
    from ..streaming.ingest import open_rejects, stream_enrichment

    root = _scratch(spark)
    broken = table(spark, folder, "customer").select(F.concat(F.lit('{"id": '), "c_custkey", F.lit(", oops")).alias("value"))
    broken.write.text(f"{root}/landed/broken")
    for _ in land_weather_jobs(spark, folder, f"{root}/landed/good"):
        for name in ("first", "second"):
            stream_enrichment(spark, f"{root}/landed/*", f"{root}/out", f"{root}/{name}").awaitTermination()
    kept = targets.read(spark, f"{root}/out", "snapshots").agg(F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("n"))
    rest = open_rejects(spark, f"{root}/out").groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(rest)


@query("training_parts", """
  WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('2|' || CAST(vec_id AS VARCHAR))) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  s AS (SELECT CASE WHEN rn <= round_even(0.2 * n, 0) THEN 'holdout' ELSE 'train' END AS part, count(*) AS n FROM r GROUP BY 1)
  SELECT kind, part, n FROM s, (SELECT 'tree' AS kind UNION ALL SELECT 'boosted')""")
def training_parts(spark, folder):
    """Training and holdout rows of the tree kinds."""
    df, _ = vectors_as_columns(spark, folder, "genus")
    df = settle(df.drop("family", "public_positional_accuracy").withColumnRenamed("genus", "sub_species"), "parts")
    out = []
    for kind in ("tree", "boosted"):
        train_rows, holdout, _, _ = modelling.training_rows(df, "sub_species", kind)
        for part, rows in (("train", train_rows), ("holdout", holdout)):
            out.append(rows.agg(F.lit(kind).alias("kind"), F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("kind_comparison", """
  SELECT DISTINCT 'family' AS level, kind, 'base' AS node, 1.0::DOUBLE AS accuracy
  FROM embeddings, (SELECT 'tree' AS kind UNION ALL SELECT 'linear')""")
def kind_comparison(spark, folder):
    """Balanced accuracy of two kinds of models on the holdout of the root."""
    df, names = vectors_as_columns(spark, folder, "family")
    _, predictions, _ = train.sweep(df, ["family"], names, ["tree", "linear"],
                                    grids={"tree": [2], "linear": [0.0]}, k=2, root_target="family")
    return with_rounded(modelling.sweep_reports(predictions)[1], "accuracy")
