"""Queries: cleaning, dates, local times, text rules, sources."""

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import clean, profile
from ..operators.ranks import exact_rank

from ..sources import readers, sinks, targets
from . import cleaning
from .adapter import (SQL_OBS, SQL_OFFSET, SQL_RAW, observations,
                      raw_observations, table)
from .catalogue import query


@query("dedupe_keep_first", """
  SELECT doc_id, lang, source, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
  WHERE rn = 1""")
def dedupe_keep_first(spark, folder):
    d = table(spark, folder, "documents").select(
        F.md5("text").alias("content"), "doc_id", "lang", "source", "n_chars")
    return clean.dedupe_first(d, "content", "doc_id").drop("content")


@query("dedupe_tied_order", """
  SELECT user_id, day, event_id, event_type, value FROM (
    SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, event_type, value,
      row_number() OVER (PARTITION BY user_id ORDER BY CAST(date_trunc('day', ts) AS DATE), event_id) AS rn FROM events)
  WHERE rn = 1""")
def dedupe_tied_order(spark, folder):
    """First row of each user by day: of several on one day the least row, whatever the partitions."""
    e = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_id", "event_type", "value")
    return clean.dedupe_first(e.repartition(7), "user_id", "day")


@query("resume_anti_join", f"""WITH {SQL_OBS}
  SELECT id, label, measure FROM obs WHERE id NOT IN (
    SELECT id FROM obs WHERE label = 'error' UNION ALL SELECT id FROM obs WHERE accuracy > 40000)""")
def resume_anti_join(spark, folder):
    o = observations(spark, folder)
    done, bad = o.where("accuracy > 40000"), o.where("label = 'error'")
    return clean.without(o, done, bad).select("id", "label", "measure")


@query("key_membership", f"""WITH {SQL_OBS}
  SELECT label, count(*) AS n FROM obs WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  GROUP BY label""")
def key_membership(spark, folder):
    keys = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    chosen = clean.only(observations(spark, folder), keys.withColumnRenamed("o_orderkey", "id"))
    return chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


WORDS = ["eaux", "tion", "the wh", "sh-in"]
SQL_WORDS = "(?i)(eaux|tion|the wh|sh-in)"


@query("keyword_route_bad", f"""
  SELECT doc_id, source AS image_url, 'bad' AS image_quality FROM documents
  WHERE regexp_matches(text, '{SQL_WORDS}')""")
def keyword_route_bad(spark, folder):
    d = table(spark, folder, "documents").withColumnRenamed("source", "image_url")
    return clean.quarantine(clean.split_quality(d, "text", WORDS)[1], "doc_id")


@query("keyword_route_good", f"""
  SELECT doc_id, lang, n_chars FROM documents
  WHERE NOT coalesce(regexp_matches(text, '{SQL_WORDS}'), false)""")
def keyword_route_good(spark, folder):
    good, _ = clean.split_quality(table(spark, folder, "documents"), "text", WORDS)
    return good.select("doc_id", "lang", "n_chars")


@query("keyword_whole_words", """
  SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text,
    '(?i)(^|[^\\p{L}\\p{M}\\p{N}_])(the|ou|dans)($|[^\\p{L}\\p{M}\\p{N}_])')
  GROUP BY lang""")
def keyword_whole_words(spark, folder):
    d = clean.flag_poor_quality(table(spark, folder, "documents"), "text", ["the", "ou", "dans"], True)
    return d.where("is_bad").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("null_audit", """
  SELECT 'event_id' AS "column", CAST(0 AS BIGINT) AS nulls, false AS has_null
  UNION ALL SELECT 'kind', count(*) FILTER (WHERE event_type = 'view'),
    count(*) FILTER (WHERE event_type = 'view') > 0 FROM events
  UNION ALL SELECT 'value', count(*) FILTER (WHERE value < 5), count(*) FILTER (WHERE value < 5) > 0 FROM events""")
def null_audit(spark, folder):
    e = table(spark, folder, "events")
    e = e.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
                 F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    return profile.null_audit(e)


@query("expectation_checks", f"""WITH {SQL_OBS},
  c AS (SELECT count(*) FILTER (WHERE NOT (latitude BETWEEN -90 AND 90)) AS a,
               count(*) FILTER (WHERE NOT accuracy <= 40000) AS b,
               count(*) FILTER (WHERE label IS NULL) AS d FROM obs)
  SELECT 'latitude_range' AS "check", a AS violations, a = 0 AS passed FROM c
  UNION ALL SELECT 'well_located', b, b = 0 FROM c UNION ALL SELECT 'labelled', d, d = 0 FROM c""")
def expectation_checks(spark, folder):
    return profile.expectations(observations(spark, folder), {
        "latitude_range": F.col("latitude").between(-90, 90),
        "well_located": F.col("accuracy") <= 40000, "labelled": F.col("label").isNotNull()})


@query("null_gate_rejects", """
  SELECT event_id FROM events WHERE value < 5 OR event_type = 'view'""")
def null_gate_rejects(spark, folder):
    e = table(spark, folder, "events").withColumn("a", F.when(F.col("value") >= 5, F.col("value"))) \
        .withColumn("b", F.when(F.col("event_type") != "view", F.col("event_type")))
    return profile.null_gate(e, ["a", "b"])[1].select("event_id")


@query("date_coerce", """
  SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS observed_on FROM events
  WHERE event_id % 4 IN (0, 1) OR (event_id % 4 = 3 AND day(ts) >= 10 AND month(ts) >= 10)""")
def date_coerce(spark, folder):
    i = F.col("event_id") % 4
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), (
        F.when(i == 2, F.date_format("ts", "yyyy-MM/dd")).when(i == 3, F.date_format("ts", "yyyy-M-d"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("observed_on"))
    return clean.valid_dates(e).withColumn("observed_on", F.date_format("observed_on", "yyyy-MM-dd"))


@query("local_time", f"""WITH {SQL_OBS}, l AS (
    SELECT id, time_zone, timezone(time_zone, timezone('UTC', date_trunc('second', ts))) AS w,
      CAST((epoch(timezone(time_zone, timezone('UTC', ts))) - epoch(ts)) / 60 AS BIGINT) AS off FROM obs)
  SELECT id, time_zone, strftime(w, '%Y-%m-%d %H:%M:%S') || {SQL_OFFSET} AS local_time FROM l""")
def local_time(spark, folder):
    return observations(spark, folder).select(
        "id", "time_zone", times.local_time_text("ts", "time_zone").alias("local_time"))


@query("local_hour_histogram", f"""WITH {SQL_OBS}
  SELECT time_zone, CAST(hour(timezone(time_zone, timezone('UTC', ts))) AS INTEGER) AS local_hour,
         count(*) AS n FROM obs GROUP BY ALL""")
def local_hour_histogram(spark, folder):
    o = observations(spark, folder).withColumn("local_hour", times.local_hour("ts", "time_zone"))
    return o.groupBy("time_zone", "local_hour").agg(F.count(F.lit(1)).alias("n")) \
            .orderBy("time_zone", "local_hour")


@query("unknown_zone_is_null", f"""WITH {SQL_OBS}
  SELECT label, count(*) FILTER (WHERE time_zone = 'UTC') AS without_local, count(*) AS n
  FROM obs GROUP BY label""")
def unknown_zone_is_null(spark, folder):
    o = observations(spark, folder).withColumn(
        "time_zone", clean_zone(F.col("time_zone")))
    return o.groupBy("label").agg(
        F.count_if(times.to_wall("ts", "time_zone").isNull()).alias("without_local"),
        F.count(F.lit(1)).alias("n"))


def clean_zone(zone):
    return F.when(zone == "UTC", "Mountain Time (US & Canada)").otherwise(zone)


@query("text_rules", """
  SELECT p_partkey AS id,
    CASE WHEN p_size > 25 THEN p_name || ' ' || p_type END AS sub_species,
    lower(replace(p_name || ' ' || p_type, ' ', '_')) AS node,
    upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title,
    substr(p_brand, 1, greatest(length(p_brand) - 6, 0)) AS cut,
    concat_ws(', ', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), CAST(CAST(p_size - 50 AS DOUBLE) AS VARCHAR)) AS place,
    CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN 'L' ELSE p_type END AS recoded
  FROM part""")
def text_rules(spark, folder):
    p = table(spark, folder, "part")
    name = F.when(F.col("p_size") > 25, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))
    size = F.col("p_size").cast("double")
    return p.select(
        F.col("p_partkey").alias("id"), text.trinomial(name).alias("sub_species"),
        text.node_key(F.concat_ws(" ", "p_name", "p_type")).alias("node"),
        text.capitalise("p_type").alias("title"), text.drop_tail("p_brand", 6).alias("cut"),
        text.coordinate_text(size, size - 50).alias("place"),
        text.recode("p_type", {"SMALL": "S", "LARGE": "L"}).alias("recoded"))


@query("conditional_fill", """
  SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'no license' ELSE c_mktsegment END AS license,
    CASE WHEN c_nationkey = 3 THEN 'three' ELSE c_name END AS name
  FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal < 0""")
def conditional_fill(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("license"),
        F.col("c_name").alias("name"), "c_nationkey")
    c = c.where(clean.differs("license", "MACHINERY")).na.fill("no license", ["license"])
    return clean.overwrite_where(c, "name", F.col("c_nationkey") == 3, "three").drop("c_nationkey")


@query("batch_numbers", """
  SELECT event_id, CAST(ceil(row_number() OVER (ORDER BY ts, event_id) / 1000.0) AS BIGINT) AS batch
  FROM events""")
def batch_numbers(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts")
    return clean.batches(e, ["ts", "event_id"]).select("event_id", "batch")


@query("group_positions", """
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank
  FROM events""")
def group_positions(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return exact_rank(e, ["ts", "event_id"], "event_type").drop("ts")


CLEAN_SQL = f"""WITH {SQL_RAW}
  SELECT id, strftime(ts, '%Y-%m-%d') AS observed_on,
    strftime(local_ts, '%Y-%m-%d %H:%M:%S') || {SQL_OFFSET} AS local_time_observed_at,
    latitude, longitude, image_url
  FROM local_rows WHERE NOT is_bad AND input_order % 17 <> 3 AND input_order % 19 <> 5"""
BAD_SQL = f"""WITH {SQL_RAW} SELECT id, image_url, 'bad' AS image_quality FROM first_rows WHERE is_bad"""


def _interim(good):
    return good.select("id", F.date_format("observed_on", "yyyy-MM-dd").alias("observed_on"),
                       "local_time_observed_at", "latitude", "longitude", "image_url")


@query("cleaning_flow_good", CLEAN_SQL)
def cleaning_flow_good(spark, folder):
    return _interim(cleaning.clean_batch(raw_observations(spark, folder))[0])


@query("cleaning_flow_bad", BAD_SQL)
def cleaning_flow_bad(spark, folder):
    return cleaning.clean_batch(raw_observations(spark, folder))[1]


@query("cleaning_files", CLEAN_SQL)
def cleaning_files(spark, folder):
    """The same job from CSV files with a file order, run twice."""
    root = _scratch(spark)
    raw = raw_observations(spark, folder)
    paths = []
    for number, half in enumerate((F.col("input_order") % 2 == 0, F.col("input_order") % 2 == 1)):
        paths.append(f"{root}/in{number}")
        sinks.overwrite(raw.where(half).drop("input_order").coalesce(1), paths[-1], "csv")
    for _ in range(2):
        cleaning.clean_files(spark, paths, f"{root}/out")
    return _interim(targets.read(spark, f"{root}/out", "interim"))


def _scratch(spark):
    import uuid

    from ..operators.storage import shared_folder
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query("ingest_stream", CLEAN_SQL)
def ingest_stream(spark, folder):
    """The cleaning job as a stream over landed files; ids repeat across files."""
    from ..streaming.ingest import stream_cleaning

    root = _scratch(spark)
    raw = raw_observations(spark, folder)
    sinks.overwrite(raw.drop("input_order").coalesce(1), f"{root}/in", "csv")
    stream_cleaning(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _interim(targets.read(spark, f"{root}/out", "interim"))


@query("landed_records", """
  SELECT event_id AS id, event_type AS kind, CAST(user_id AS BIGINT) AS user_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS reading
  FROM events WHERE event_id BETWEEN 1 AND 1000000000000""")
def landed_records(spark, folder):
    e = table(spark, folder, "events")
    reading = F.when(F.col("event_type") == "error", F.lit("None")).otherwise(
        (F.col("event_id") % 100).cast("double").cast("string"))
    records = e.select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), "event_type",
                                              F.concat(F.col("user_id"), F.lit("\n")), reading).alias("record"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()),
                           T.StructField("user_id", T.LongType()), T.StructField("reading", T.DoubleType())])
    return readers.split_records(records, "record", schema, "event_id", 1, 10 ** 12).drop("event_id")


@query("keyed_csv_scan", """
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer""")
def keyed_csv_scan(spark, folder):
    """Written as CSV with an unnamed first column, read back by key."""
    from pyspark.sql import types as T

    path = f"{_scratch(spark)}/keyed"
    c = table(spark, folder, "customer")
    sinks.overwrite(c.select(F.col("c_custkey").alias("_c0"), "c_name", "c_acctbal"), path, "csv")
    schema = T.StructType([T.StructField("_c0", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("balance", T.DoubleType())])
    return readers.read_keyed_csv(spark, path, schema)


@query("union_by_name", """
  SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
  UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark, folder):
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return readers.union_all([s, c]).select("id", "name", "balance", "segment")


@query("sub_image_parts", """
  WITH p AS (SELECT vec_id // 6 AS id, vec_id % 6 AS o FROM embeddings),
  p2 AS (SELECT id, CASE WHEN (id * 6 + o) % 7 = 3 THEN 25 ELSE o END AS o FROM p),
  q AS (SELECT id, o, dense_rank() OVER (PARTITION BY id ORDER BY o) - 1 AS rn FROM p2)
  SELECT id, chr(CAST(97 + o AS INTEGER)) AS suffix FROM q WHERE rn = o""")
def sub_image_parts(spark, folder):
    e = table(spark, folder, "embeddings")
    letter = F.when(F.col("vec_id") % 7 == 3, 25).otherwise(F.col("vec_id") % 6)  # gaps, and a last letter
    parts = e.select(F.floor(F.col("vec_id") / 6).alias("id"), F.char(97 + letter).alias("suffix"))
    return readers.consecutive_parts(parts)


@query("snapshot_json", """
  SELECT to_json({'id': event_id, 'kind': event_type, 'user': user_id}) AS json FROM events""")
def snapshot_json(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"),
                                              F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return sinks.snapshot_json(e)


@query("append_twice", f"""WITH {SQL_OBS}
  SELECT label, count(*) AS n, sum(user_id) AS users FROM obs WHERE accuracy <= 40000 GROUP BY label""")
def append_twice(spark, folder):
    """Key-checked append: the second, overlapping write adds only new ids."""
    path = f"{_scratch(spark)}/target"
    o = observations(spark, folder).where("accuracy <= 40000").select("id", "label", "user_id")
    sinks.append_new(o.where("label <> 'view'"), path, "id")
    sinks.append_new(o, path, "id")
    return spark.read.parquet(path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("two_target_commit", f"""WITH {SQL_OBS}
  SELECT 'far' AS target, label, count(*) AS n, sum(user_id) AS users FROM obs WHERE accuracy > 40000 GROUP BY label
  UNION ALL SELECT 'near', label, count(*), sum(user_id) FROM obs WHERE accuracy <= 40000 GROUP BY label""")
def two_target_commit(spark, folder):
    """A batch, one that fails after its first target is written, and an overlapping one: each id once."""
    root = _scratch(spark)
    o = observations(spark, folder).select("id", "label", "user_id", "accuracy")

    def run(rows, broken=False):
        near = rows.where("accuracy <= 40000")
        if broken:
            near = near.withColumn("user_id", F.when(F.col("id") >= 0, F.raise_error(F.lit("stopped")).cast("long")))
        targets.commit_together(spark, root, {"far": (rows.where("accuracy > 40000"), "id"), "near": (near, "id")})

    run(o.where("label <> 'view'"))
    try:
        run(o, broken=True)
    except Exception as error:
        if "stopped" not in str(error):
            raise
    seen = targets.read(spark, root, "far").where("label = 'view'")
    if not seen.isEmpty():
        raise AssertionError("rows of a failed batch can be seen")
    run(o)
    parts = [targets.read(spark, root, t).withColumn("target", F.lit(t)) for t in ("far", "near")]
    return parts[0].unionByName(parts[1]).groupBy("target", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
