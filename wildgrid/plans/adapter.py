"""The driver tables seen as observations, readings and scores.

Every column is integer arithmetic or text of the given tables, so the same
table can be written in SQL; the SQL form stands next to each function.
"""

from pyspark.sql import functions as F

from ..operators.storage import remove
from ..schemas import DAILY, DAILY_TEXT, HOURLY, CODES

#: Jobs that lie as JSON on the disk at once: about 3 GB of text, 0.25 GB as gzip.
JOBS_LANDED = 500_000

ZONE_CYCLE = ["UTC", "Australia/Sydney", "America/Denver", "Africa/Johannesburg"]


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column, digits=6):
    """Rounded value; the SQL side says the same.

    Sums of doubles differ in the last bits between engines. The small offset
    keeps means that end exactly on a half from rounding either way.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits)


def with_rounded(df, *columns, digits=6):
    return df.select(*[rounded(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def observations(spark, folder):
    """events as observations with a place, an accuracy and a zone."""
    e = with_place(table(spark, folder, "events"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("label"), F.concat(F.lit("P"), F.col("user_id") % 3).alias("parent"),
        "user_id", "latitude", "longitude", "accuracy", "time_zone", F.col("value").alias("measure"))


def with_place(events):
    """Add place, accuracy and zone to events."""
    i = F.col("event_id")
    zones = F.array(*[F.lit(z) for z in ZONE_CYCLE])
    return events.select(
        "*", ((i * 37) % 181 - 90).cast("double").alias("latitude"),
        ((i * 53) % 361 - 180).cast("double").alias("longitude"),
        ((i * 7919) % 60000).cast("double").alias("accuracy"),
        F.get(zones, (i % 4).cast("int")).alias("time_zone"))


SQL_OBS = """obs AS (
  SELECT event_id AS id, ts, event_type AS label, 'P' || (user_id % 3) AS parent, user_id,
         CAST((event_id * 37) % 181 - 90 AS DOUBLE) AS latitude,
         CAST((event_id * 53) % 361 - 180 AS DOUBLE) AS longitude,
         CAST((event_id * 7919) % 60000 AS DOUBLE) AS accuracy,
         CASE event_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Australia/Sydney'
              WHEN 2 THEN 'America/Denver' ELSE 'Africa/Johannesburg' END AS time_zone,
         value AS measure
  FROM events)"""


def raw_observations(spark, folder):
    """events as raw uploads with repeated ids, broken dates, missing times and remarks."""
    i = F.col("event_id")
    e = with_place(table(spark, folder, "events"))
    day = F.date_format("ts", "yyyy-MM-dd")
    observed = (F.when(i % 17 == 3, F.date_format("ts", "yyyy-MM/dd"))
                .when(i % 19 == 5, F.concat(F.lit("202g"), F.substring(day, 5, 6))).otherwise(day))
    seen = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    kind = F.col("event_type")
    remark = (F.when(kind == "error", "Found Dead near the path").when(kind == "purchase", "badger sett")
              .when(kind == "signup", "A nice view").when(kind == "view", "walking"))
    text = lambda v: F.lit(v).cast("string")
    return e.select(
        F.when(i % 10 == 9, i - 1).otherwise(i).alias("id"), observed.alias("observed_on"),
        "latitude", "longitude", F.when(i % 23 != 7, seen).alias("time_observed_at"), "time_zone",
        text("research").alias("quality_grade"), text("CC-BY").alias("license"),
        F.concat(F.lit("u/"), i).alias("url"), F.concat(F.lit("i/"), i).alias("image_url"),
        remark.alias("description"), F.col("accuracy").alias("positional_accuracy"),
        F.col("accuracy").alias("public_positional_accuracy"), text("").alias("geoprivacy"),
        text("open").alias("taxon_geoprivacy"),
        F.concat(F.lit("Genus"), F.col("user_id") % 3, F.lit(" "), kind,
                 F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" sub"), F.col("user_id") % 4))
                 .otherwise("")).alias("scientific_name"),
        F.concat(F.lit("The "), kind).alias("common_name"), F.col("user_id").alias("taxon_id"),
        *[text(None).alias(f"taxon_{n}_name") for n in ("kingdom", "phylum", "class", "order")],
        F.concat(F.lit("Family"), F.col("user_id") % 2).alias("taxon_family_name"),
        F.concat(F.lit("Genus"), F.col("user_id") % 3).alias("taxon_genus_name"),
        F.concat(F.lit("Genus"), F.col("user_id") % 3, F.lit(" "), kind).alias("taxon_species_name"),
        i.alias("input_order"))


SQL_RAW = SQL_OBS + """, raw AS (
  SELECT CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS id,
         CASE WHEN event_id % 17 = 3 THEN strftime(e.ts, '%Y-%m/%d')
              WHEN event_id % 19 = 5 THEN '202g' || strftime(e.ts, '-%m-%d')
              ELSE strftime(e.ts, '%Y-%m-%d') END AS observed_on,
         o.latitude, o.longitude, o.accuracy, o.time_zone, e.ts, e.user_id, event_type,
         event_id % 23 <> 7 AS has_time, event_id AS input_order,
         event_type IN ('error', 'purchase') AS is_bad, 'i/' || event_id AS image_url
  FROM events e JOIN obs o ON o.id = e.event_id),
 first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY input_order) AS rn
                               FROM raw) WHERE rn = 1 AND has_time),
 local_rows AS (SELECT *, timezone(time_zone, timezone('UTC', date_trunc('second', ts))) AS local_ts,
         CAST((epoch(timezone(time_zone, timezone('UTC', ts))) - epoch(ts)) / 60 AS BIGINT) AS off
         FROM first_rows)"""

SQL_OFFSET = """CASE WHEN off < 0 THEN '-' ELSE '+' END
  || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0')"""


def weather_jobs(spark, folder, part=0, parts=1):
    """One job per event with a full payload made from its value and user.

    The payload lacks one hour of the day, and some have a missing reading. With
    ``parts`` the jobs of one part of the ids, those of equal ids together.
    """
    # Payloads are many times larger than the events they are made from, so the
    # number of tasks is not left to the size of the events.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = with_place(table(spark, folder, "events"))
    if parts > 1:
        e = e.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part)
    e = e.repartition(tasks, "event_id")
    i, v = F.col("event_id"), F.col("value")
    day = F.date_format("ts", "yyyy-MM-dd")
    e = e.withColumn("hours", F.filter(F.sequence(F.lit(0), F.lit(23)),
                                       lambda h: h != F.col("user_id") % 24))
    hours = F.col("hours")
    stamp = F.transform(hours, lambda h: F.concat(day, F.lit("T"), F.lpad(h.cast("string"), 2, "0"),
                                                  F.lit(":00")))

    def series(number, name):
        if name in CODES:
            return F.transform(hours, lambda h: (h + number).cast("int"))
        if name == "rain":
            return F.transform(hours, lambda h: F.when(i % 13 != 4, v + h))
        return F.transform(hours, lambda h: v + h + number)

    hourly = F.struct(stamp.alias("time"), *[series(k, n).alias(n) for k, n in enumerate(HOURLY)])

    def single(number, name):
        if name in DAILY_TEXT:
            return F.array(F.concat(day, F.lit("T06:10" if name == "sunrise" else "T18:20")))
        if name in CODES:
            return F.array((i % 50).cast("int"))
        return F.array(v * 2 + number)

    daily = F.struct(*[single(k, n).alias(n) for k, n in enumerate(DAILY)])
    payload = F.struct(F.lit("UTC").alias("timezone"), (i % 100).cast("double").alias("elevation"),
                       hourly.alias("hourly"), daily.alias("daily"))
    return e.select(
        i.alias("id"), "latitude", "longitude",
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("obs_time"),
        day.alias("start_date"), day.alias("end_date"), payload.alias("payload"))


def land_weather_jobs(spark, folder, path):
    """Land all jobs at a path, in parts of about JOBS_LANDED: yields when one lies there, removes it after that."""
    parts = max(1, -(-table(spark, folder, "events").count() // JOBS_LANDED))
    for part in range(parts):
        weather_jobs(spark, folder, part, parts).write.option("compression", "gzip").json(path)
        yield part
        remove(spark, path)


SQL_JOBS = """jobs AS (SELECT event_id AS id, value AS v, hour(ts) AS h, ts,
    hour(ts) = user_id % 24 AS no_hour, event_id % 13 = 4 AS no_rain FROM events)"""


LEVELS3 = ["r_name", "n_name", "c_mktsegment"]
WEIGHTS3 = {"r_name": 0.1, "n_name": 0.2, "c_mktsegment": 0.5}


def customer_truth(spark, folder):
    """Customers with a three-level label path: region, nation, segment.

    Region 0 keeps one nation only, so that its node has a single child, and
    some customers have no segment.
    """
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    path = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "r_name", F.when(F.col("r_regionkey") == 0, "ONLY")
        .otherwise(F.col("n_name")).alias("n_name"))
    return c.join(path, c.c_nationkey == path.n_nationkey).select(
        F.col("c_custkey").alias("id"), "r_name", "n_name",
        F.when(F.col("c_custkey") % 11 != 0, F.concat_ws("/", "n_name", "c_mktsegment"))
        .alias("c_mktsegment"))


def class_scores(truth, edges, key="id"):
    """Repeatable scores for every child of every node on the way of a row.

    Long probabilities: metadata once, images in two parts. The true child gets
    a bonus that is missing for some rows, so both right and wrong rows occur.
    """
    steps, upper = [], F.lit("base")
    for level in LEVELS3:
        steps.append(F.struct(F.lit(level).alias("level"), upper.alias("node"),
                              F.col(level).alias("true_child")))
        upper = F.col(level)
    nodes = truth.select(key, F.explode(F.array(*steps)).alias("s")).select(key, "s.*") \
                 .where("node is not null")
    e = edges.select("level", F.col("parent").alias("node"), F.col("child").alias("class"), "ordinal")
    scored = nodes.join(e, ["level", "node"])
    base = ((F.col(key) * 31 + F.col("ordinal") * 17) % 7 + 1).cast("double")
    hit = F.coalesce(F.col("class") == F.col("true_child"), F.lit(False))
    meta = base + F.when(hit & (F.col(key) % 5 != 0), 4.0).otherwise(0.0)
    image = base + F.when(hit & (F.col(key) % 3 != 0), 6.0).otherwise(0.0)
    parts = F.array(
        F.struct(F.lit("meta").alias("source"), F.lit(None).cast("string").alias("suffix"), meta.alias("p")),
        F.struct(F.lit("image").alias("source"), F.lit("a").alias("suffix"), image.alias("p")),
        F.struct(F.lit("image").alias("source"), F.lit("b").alias("suffix"), (image + base).alias("p")))
    return scored.select(key, "level", "node", "class", "ordinal", F.explode(parts).alias("x")) \
                 .select(key, "level", "node", "class", "ordinal", "x.*")


SQL_TRUTH = """truth AS (
  SELECT c_custkey AS id, r_name, CASE WHEN r_regionkey = 0 THEN 'ONLY' ELSE n.n_name END AS n_name,
         CASE WHEN c_custkey % 11 <> 0 THEN
           (CASE WHEN r_regionkey = 0 THEN 'ONLY' ELSE n.n_name END) || '/' || c_mktsegment END AS seg
  FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 pairs AS (SELECT DISTINCT 1 AS lvl, 'base' AS node, r_name AS cls FROM truth
   UNION SELECT DISTINCT 2, r_name, n_name FROM truth
   UNION SELECT DISTINCT 3, n_name, seg FROM truth WHERE seg IS NOT NULL),
 edges AS (SELECT *, row_number() OVER (PARTITION BY lvl, node ORDER BY cls) - 1 AS ordinal,
           count(*) OVER (PARTITION BY lvl, node) AS k FROM pairs),
 steps AS (SELECT id, 1 AS lvl, 'base' AS node, r_name AS tc FROM truth
   UNION ALL SELECT id, 2, r_name, n_name FROM truth
   UNION ALL SELECT id, 3, n_name, seg FROM truth),
 scored AS (SELECT id, s.lvl, s.node, cls, ordinal, k, tc,
     CAST((id * 31 + ordinal * 17) % 7 + 1 AS DOUBLE) AS b, coalesce(cls = tc, false) AS hit
   FROM steps s JOIN edges e ON s.lvl = e.lvl AND s.node = e.node),
 vec AS (SELECT *, b + CASE WHEN hit AND id % 5 <> 0 THEN 4.0 ELSE 0 END AS m,
     ((b + CASE WHEN hit AND id % 3 <> 0 THEN 6.0 ELSE 0 END)
      + (b + CASE WHEN hit AND id % 3 <> 0 THEN 6.0 ELSE 0 END + b)) / 2 AS i0 FROM scored),
 vec2 AS (SELECT *, i0 / sum(i0) OVER (PARTITION BY id, lvl, node) AS im FROM vec),
 jnt AS (SELECT *, m * w + im * (1 - w) AS j FROM vec2
   JOIN (VALUES (1, 0.1::DOUBLE), (2, 0.2::DOUBLE), (3, 0.5::DOUBLE)) wt(l, w) ON wt.l = vec2.lvl),
 dec AS (SELECT id, lvl, node, max(k) AS k, max(tc) AS tc,
     arg_max(cls, (round(j, 12), -ordinal)) AS jp, arg_max(cls, (round(im, 12), -ordinal)) AS ip,
     arg_max(cls, (m, -ordinal)) AS mp FROM jnt GROUP BY ALL),
 l1 AS (SELECT id, jp, ip, mp, tc FROM dec WHERE lvl = 1 AND k > 1),
 s2 AS (SELECT t.id, t.r_name AS node FROM truth t JOIN l1 USING (id) WHERE l1.jp = l1.tc),
 l2 AS (SELECT d.* FROM dec d JOIN s2 ON d.id = s2.id AND d.node = s2.node AND d.lvl = 2),
 s3 AS (SELECT id, CASE WHEN k = 1 THEN jp WHEN jp = tc THEN jp END AS node FROM l2),
 l3 AS (SELECT d.* FROM dec d JOIN s3 ON d.id = s3.id AND d.node = s3.node AND d.lvl = 3
        WHERE d.k > 1 AND d.tc IS NOT NULL),
 results AS (
   SELECT id, 'r_name' AS taxonomic_level, jp AS joint_prediction, ip AS image_prediction,
          mp AS meta_prediction, tc AS true_label FROM l1
   UNION ALL SELECT id, 'n_name', jp, ip, mp, tc FROM l2 WHERE k > 1
   UNION ALL SELECT id, 'c_mktsegment', jp, ip, mp, tc FROM l3)"""
