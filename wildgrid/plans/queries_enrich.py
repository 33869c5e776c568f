"""Queries: readings, zones, land, seasons, daylight, clusters, features."""

from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import clean, cluster, enrich, features
from ..operators.profile import value_counts
from ..operators.storage import settle
from ..sources import targets
from ..sources.readers import parse_payload
from .adapter import (SQL_JOBS, SQL_OBS, SQL_RAW, land_weather_jobs, observations, raw_observations, table,
                      weather_jobs, with_rounded)
from .catalogue import query


@query("payload_hour_lookup", """
  WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, avg(value) FILTER (WHERE event_type <> 'error') AS v,
             count(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY ALL)
  SELECT event_id AS id, strftime(date_trunc('hour', e.ts), '%Y-%m-%dT%H:%M') AS time,
    round(v + 1e-9, 6) AS reading, n
  FROM events e LEFT JOIN h ON h.user_id = e.user_id AND h.hr = date_trunc('hour', e.ts) AND n > 0""")
def payload_hour_lookup(spark, folder):
    """Hourly readings per user and day as JSON with parallel arrays, looked up by hour."""
    from pyspark.sql import types as T

    e = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    good = F.when(F.col("event_type") != "error", F.col("value"))
    hours = e.groupBy("user_id", "day", times.hour_key("ts").alias("time")).agg(
        F.avg(good).alias("reading"), F.count_if(F.col("event_type") != "error").alias("n"))
    # At most 24 entries per user and day; hours of errors alone are missing from the payload.
    arrays = F.filter(F.array_sort(F.collect_list(F.struct("time", "reading", "n"))), lambda a: a["n"] > 0)
    payload = hours.groupBy("user_id", "day").agg(arrays.alias("a")).select(
        "user_id", "day", F.to_json(F.struct(F.struct(
            F.col("a.time").alias("time"), F.col("a.reading").alias("reading"),
            F.col("a.n").alias("n")).alias("hourly"))).alias("json"))
    schema = T.StructType([T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("reading", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType()))]))])
    jobs = e.select("event_id", "user_id", "day", "ts").join(payload, ["user_id", "day"])
    parsed = parse_payload(jobs, "json", schema)
    picked = enrich.pick_hour(parsed, "ts", "payload.hourly", ["reading", "n"])
    return with_rounded(picked.select(F.col("event_id").alias("id"), "time", "reading", "n"), "reading")


@query("hour_table_join", """
  WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, max(value) FILTER (WHERE event_type = 'view') AS v
             FROM events GROUP BY ALL)
  SELECT event_id AS id, v AS reading FROM events e JOIN h ON h.user_id = e.user_id AND h.hr = date_trunc('hour', e.ts)""")
def hour_table_join(spark, folder):
    e = table(spark, folder, "events")
    seen = F.when(F.col("event_type") == "view", F.col("value"))
    hours = e.groupBy("user_id", times.hour_key("ts").alias("hour")).agg(F.max(seen).alias("reading"))
    joined = enrich.hour_join(e, hours, "user_id", "ts")
    return joined.select(F.col("event_id").alias("id"), "reading")


@query("weather_snapshots", f"""WITH {SQL_JOBS}
  SELECT id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') AS time, round(v + h + 1e-9, 6) AS temperature_2m,
    round(v + h + 28 + 1e-9, 6) AS soil_moisture_28_to_100cm, CAST(h + 21 AS INTEGER) AS weathercode_hourly,
    CAST(id % 50 AS INTEGER) AS weathercode_daily, round(v * 2 + 1 + 1e-9, 6) AS temperature_2m_max,
    round(v * 2 + 15 + 1e-9, 6) AS et0_fao_evapotranspiration_daily, strftime(ts, '%Y-%m-%d') || 'T06:10' AS sunrise,
    CAST(id % 100 AS DOUBLE) AS elevation
  FROM jobs WHERE NOT no_hour AND NOT no_rain""")
def weather_snapshots(spark, folder):
    kept, _ = enrich.snapshots(weather_jobs(spark, folder))
    numbers = ["temperature_2m", "soil_moisture_28_to_100cm", "temperature_2m_max",
               "et0_fao_evapotranspiration_daily"]
    return with_rounded(kept.select("id", "time", *numbers, "weathercode_hourly", "weathercode_daily",
                                    "sunrise", "elevation"), *numbers)


@query("enrichment_errors", f"""WITH {SQL_JOBS}
  SELECT CASE WHEN no_hour THEN 'no such hour' ELSE 'missing reading' END AS reason, count(*) AS errors
  FROM jobs WHERE no_hour OR no_rain GROUP BY 1""")
def enrichment_errors(spark, folder):
    return enrich.error_counts(enrich.snapshots(weather_jobs(spark, folder))[1])


@query("enrich_stream", f"""WITH {SQL_JOBS}
  SELECT id, round(v + h + 1e-9, 6) AS temperature_2m, CAST(h + 21 AS INTEGER) AS weathercode_hourly
  FROM jobs WHERE NOT no_hour AND NOT no_rain""")
def enrich_stream(spark, folder):
    """The same enrichment as a stream over landed JSON files, which go when the stream has read them."""
    from ..streaming.ingest import stream_enrichment
    from .queries_clean import _scratch

    root = _scratch(spark)
    for _ in land_weather_jobs(spark, folder, f"{root}/landed"):
        stream_enrichment(spark, f"{root}/landed", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = targets.read(spark, f"{root}/out", "snapshots")
    return with_rounded(out.select("id", "temperature_2m", "weathercode_hourly"), "temperature_2m")


@query("job_dates", """
  SELECT event_id AS id, strftime(CASE WHEN user_id % 2 = 0 THEN ts ELSE ts END, '%Y-%m-%d') AS start_date,
    CASE WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END AS end_date
  FROM events""")
def job_dates(spark, folder):
    """Jobs of even users start a day early and are corrected; the others stay."""
    even = F.col("user_id") % 2 == 0
    e = table(spark, folder, "events")
    day, later = F.to_date("ts"), F.date_add(F.to_date("ts"), 1)
    jobs = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+01:00")).alias("obs_time"),
        F.date_format(F.when(even, F.date_sub(day, 1)).otherwise(day), "yyyy-MM-dd").alias("start_date"),
        F.date_format(later, "yyyy-MM-dd").alias("end_date"))
    return enrich.corrected_jobs(jobs).select("id", "start_date", "end_date")


@query("join_suffixes", f"""WITH {SQL_OBS}
  SELECT o.id, o.measure AS measure_x, w.measure AS measure_y, label FROM obs o
  JOIN (SELECT o_orderkey AS id, o_totalprice AS measure FROM orders) w ON o.id = w.id""")
def join_suffixes(spark, folder):
    left = observations(spark, folder).select("id", "measure", "label")
    right = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("measure"))
    return enrich.join_with_suffixes(left, right, "id")


def nation_zones(spark, folder):
    """One L-shaped polygon per nation: a tall west part and a low east part."""
    k = F.col("n_nationkey")
    west = (k * 14 - 180).cast("double")
    low, top, mid = (k - 60).cast("double"), (60 - k).cast("double"), (k - 40).cast("double")
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(corner(west, low), corner(west + 12.5, low), corner(west + 12.5, mid),
                   corner(west + 5, mid), corner(west + 5, top), corner(west, top), corner(west, low))
    return table(spark, folder, "nation").select(F.col("n_name").alias("zone"), ring.alias("ring"))


@query("zone_of_point", f"""WITH {SQL_OBS},
  z AS (SELECT n_name, n_nationkey * 14 - 180 AS w, n_nationkey AS k FROM nation)
  SELECT id, latitude, longitude, n_name AS time_zone FROM obs LEFT JOIN z ON
    (latitude >= k - 60 AND latitude < k - 40 AND longitude >= w AND longitude < w + 12.5) OR
    (latitude >= k - 40 AND latitude < 60 - k AND longitude >= w AND longitude < w + 5)""")
def zone_of_point(spark, folder):
    cells = enrich.polygon_cells(nation_zones(spark, folder))
    o = observations(spark, folder).select("id", "latitude", "longitude")
    return enrich.zone_of_point(o, cells)


@query("zone_of_rings", f"""WITH {SQL_OBS},
  z AS (SELECT n_name, n_nationkey AS k, n_nationkey * 14 - 172 AS w FROM nation),
  f AS (SELECT id, latitude, longitude, CASE WHEN longitude < w THEN longitude + 360 ELSE longitude END - w AS x, n_name, k
    FROM obs, z)
  SELECT o.id, o.latitude, o.longitude, min(n_name) FILTER (WHERE
      (x >= 0 AND x < 13.5 AND o.latitude >= k - 50.5 AND o.latitude < 40.5 AND NOT
        (x >= 4 AND x < 8 AND o.latitude >= -20.5 AND o.latitude < 10.5)) OR
      (x >= 5 AND x < 7 AND o.latitude >= 60.5 AND o.latitude < 70.5)) AS time_zone
  FROM f o GROUP BY ALL""")
def zone_of_rings(spark, folder):
    """Zones with a hole and a second part; the last of them cross the date line."""
    k = F.col("n_nationkey")
    west = (k * 14 - 172).cast("double")

    def box(w, e, s, n):
        x = lambda v: F.when(v >= 180, v - 360).otherwise(v)
        corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
        return F.array(*[F.struct(x(west + F.lit(a)).alias("lon"), b.cast("double").alias("lat")) for a, b in corners])

    rings = F.array(box(0.0, 13.5, k - 50.5, F.lit(40.5)), box(4.0, 8.0, F.lit(-20.5), F.lit(10.5)),
                    box(5.0, 7.0, F.lit(60.5), F.lit(70.5)))
    zones = table(spark, folder, "nation").select(F.col("n_name").alias("zone"), rings.alias("ring"))
    o = observations(spark, folder).select("id", "latitude", "longitude")
    return enrich.zone_of_point(o, enrich.polygon_cells(zones))


@query("country_of_point", f"""WITH {SQL_OBS},
  z AS (SELECT n_name, n_nationkey * 14 - 180 AS w, n_nationkey AS k FROM nation),
  j AS (SELECT id, n_name FROM obs LEFT JOIN z ON
    (latitude >= k - 60 AND latitude < k - 40 AND longitude >= w AND longitude < w + 12.5) OR
    (latitude >= k - 40 AND latitude < 60 - k AND longitude >= w AND longitude < w + 5))
  SELECT n_name AS country, count(*) AS n FROM j GROUP BY 1""")
def country_of_point(spark, folder):
    """The same lookup with a country table and a finer grid."""
    cells = enrich.polygon_cells(nation_zones(spark, folder), per_degree=2)
    o = observations(spark, folder).select("id", "latitude", "longitude")
    found = enrich.zone_of_point(o, cells, name="country", per_degree=2)
    return found.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("land_flag", f"""WITH {SQL_OBS},
  g AS (SELECT p_partkey % 181 - 90 AS la, (p_partkey * 7) % 361 - 180 AS lo, max(p_size % 2) AS land FROM part GROUP BY ALL)
  SELECT id, CAST(coalesce(land, 0) AS INTEGER) AS land FROM obs LEFT JOIN g ON floor(latitude) = la AND floor(longitude) = lo""")
def land_flag(spark, folder):
    p = F.col("p_partkey")
    grid = table(spark, folder, "part").groupBy(
        (p % 181 - 90).cast("int").alias("cell_lat"), ((p * 7) % 361 - 180).cast("int").alias("cell_lon")) \
        .agg(F.max((F.col("p_size") % 2).cast("int")).alias("land"))
    return enrich.land_flag(observations(spark, folder), grid).select("id", "land")


@query("season_counts", """
  WITH o AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS m, (o_orderkey * 37) % 181 - 90 >= 0 AS north FROM orders),
  s AS (SELECT CAST(north AS INTEGER) AS hemisphere, CASE
      WHEN m IN (12, 1, 2) THEN CASE WHEN north THEN 'Winter' ELSE 'Summer' END
      WHEN m IN (3, 4, 5) THEN CASE WHEN north THEN 'Spring' ELSE 'Autumn' END
      WHEN m IN (6, 7, 8) THEN CASE WHEN north THEN 'Summer' ELSE 'Winter' END
      ELSE CASE WHEN north THEN 'Autumn' ELSE 'Spring' END END AS season FROM o)
  SELECT hemisphere, season, count(*) AS n FROM s GROUP BY ALL""")
def season_counts(spark, folder):
    o = table(spark, folder, "orders").select(
        F.month("o_orderdate").alias("m"), geo.hemisphere((F.col("o_orderkey") * 37) % 181 - 90).alias("hemisphere"))
    return o.groupBy("hemisphere", geo.season("m", "hemisphere").alias("season")) \
            .agg(F.count(F.lit(1)).alias("n"))


@query("season_dummies", """
  WITH o AS (SELECT o_orderkey, (month(o_orderdate) % 12) // 3 AS q FROM orders)
  SELECT o_orderkey, CAST(q = 1 AS INTEGER) AS szn_Spring, CAST(q = 2 AS INTEGER) AS szn_Summer,
    CAST(q = 3 AS INTEGER) AS szn_Autumn FROM o""")
def season_dummies(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_orderkey", geo.season(F.month("o_orderdate"), F.lit(1)).alias("season"))
    return features.fixed_dummies(o, "season", geo.SEASONS, "szn")


@query("fitted_dummies", """
  SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS st_O, CAST(o_orderstatus = 'P' AS INTEGER) AS st_P FROM orders""")
def fitted_dummies(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return features.fixed_dummies(o, "o_orderstatus", features.fit_categories(o, "o_orderstatus"), "st")


@query("label_vectors", """
  SELECT o_orderkey, [CAST(o_orderstatus = 'F' AS INTEGER), CAST(o_orderstatus = 'O' AS INTEGER),
    CAST(o_orderstatus = 'P' AS INTEGER)] AS label_vector FROM orders""")
def label_vectors(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    classes = features.fit_categories(o, "o_orderstatus")
    return features.label_vector(o, "o_orderstatus", classes).drop("o_orderstatus")


@query("label_index", """
  SELECT o_orderkey, o_orderpriority AS label, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label_index
  FROM orders""")
def label_index(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    model = features.fit_label_index(o, "o_orderpriority")
    indexed = model.transform(o).drop("o_orderpriority")
    return features.label_names(indexed, "label_index", model.labels)


@query("standardised", """
  WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm,
    stddev_pop(l_extendedprice) AS ps FROM lineitem)
  SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs + 1e-9, 6) AS l_quantity,
    round((l_extendedprice - pm) / ps + 1e-9, 6) AS l_extendedprice FROM lineitem, s""")
def standardised(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    columns = ["l_quantity", "l_extendedprice"]
    return with_rounded(features.standardise(li, features.fit_scaler(li, columns)), *columns)


@query("daylight_flag", f"""WITH {SQL_OBS}, w AS (SELECT id, timezone(time_zone, timezone('UTC', ts)) AS l FROM obs)
  SELECT id, CAST(l BETWEEN date_trunc('day', l) + INTERVAL '6 hours 10 minutes'
    AND date_trunc('day', l) + INTERVAL '18 hours 20 minutes' AS INTEGER) AS light FROM w""")
def daylight_flag(spark, folder):
    o = observations(spark, folder)
    day = F.date_format(times.to_wall("ts", "time_zone"), "yyyy-MM-dd")
    o = o.withColumn("sunrise", times.wall_time(F.concat(day, F.lit("T06:10")))) \
         .withColumn("sunset", times.wall_time(F.concat(day, F.lit("T18:20"))))
    return o.select("id", times.daylight("ts", "sunrise", "sunset", "time_zone").alias("light"))


CENTROIDS = [[-60.0, -150.0], [-60.0, -30.0], [-60.0, 90.0], [-20.0, -120.0], [-20.0, 0.0], [-20.0, 120.0],
             [20.0, -150.0], [20.0, -30.0], [20.0, 90.0], [60.0, -120.0], [60.0, 0.0], [60.0, 120.0]]
SQL_NEAREST = SQL_OBS + ", c(k, la, lo) AS (VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(CENTROIDS)) + """),
  near AS (SELECT id, latitude, longitude, CAST(arg_min(k, ((latitude - la) ** 2 + (longitude - lo) ** 2, k)) AS INTEGER)
    AS location_cluster FROM obs, c GROUP BY ALL)"""


@query("nearest_centroid", f"WITH {SQL_NEAREST} SELECT id, location_cluster FROM near")
def nearest_centroid(spark, folder):
    return features.location_cluster(observations(spark, folder), CENTROIDS).select("id", "location_cluster")


@query("hotspot_density", f"WITH {SQL_NEAREST} SELECT location_cluster, count(*) AS n FROM near GROUP BY 1")
def hotspot_density(spark, folder):
    return cluster.density(features.location_cluster(observations(spark, folder), CENTROIDS))


@query("elbow_fixed", f"""WITH {SQL_NEAREST}
  SELECT location_cluster, sum((latitude - la) ** 2 + (longitude - lo) ** 2) AS cost, count(*) AS n
  FROM near JOIN c ON k = location_cluster GROUP BY 1""")
def elbow_fixed(spark, folder):
    o = features.location_cluster(observations(spark, folder), CENTROIDS)
    return cluster.within_cost(o, ["latitude", "longitude"], CENTROIDS, "location_cluster")


@query("silhouette_fixed", """
  WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n
        FROM p a, p b GROUP BY ALL),
  q AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size,
        max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b
        FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-9, 6) AS silhouette FROM q""")
def silhouette_fixed(spark, folder):
    e = table(spark, folder, "embeddings")
    return with_rounded(cluster.silhouette(e, "embedding", "label"), "silhouette")


LIGHT = """date_trunc('day', local_ts) + INTERVAL '{}'"""


@query("observation_features", f"""WITH {SQL_RAW}, c(k, la, lo) AS (VALUES {", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(CENTROIDS))}),
  g AS (SELECT id, ts, latitude, longitude, local_ts, 'Genus' || (user_id % 3) || ' ' || event_type AS sp,
      CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 100 AS DOUBLE) END AS el0
    FROM local_rows WHERE accuracy <= 40000 AND NOT is_bad),
  z AS (SELECT sp FROM g GROUP BY 1 HAVING count(*) >= 5),
  f AS (SELECT *, nullif(el0, 0) AS el, latitude >= 0 AS north, (month(ts) % 12) // 3 AS q FROM g
        WHERE sp IN (SELECT sp FROM z)),
  m AS (SELECT sp, avg(el) AS mean FROM f GROUP BY 1),
  n AS (SELECT f.id, arg_min(k, ((latitude - la) ** 2 + (longitude - lo) ** 2, k)) AS cl FROM f, c GROUP BY 1)
  SELECT f.id, f.sp AS taxon_species_name, CAST(cl AS INTEGER) AS location_cluster,
    round(coalesce(el, mean) + 1e-9, 6) AS elevation, CAST(north AS INTEGER) AS hemisphere,
    CAST(month(ts) AS INTEGER) AS month, CAST(hour(local_ts) AS INTEGER) AS hour,
    CAST(local_ts BETWEEN {LIGHT.format('6 hours 10 minutes')} AND {LIGHT.format('18 hours 20 minutes')} AS INTEGER) AS light,
    CAST((CASE WHEN north THEN q ELSE (q + 2) % 4 END) = 1 AS INTEGER) AS szn_Spring,
    CAST((CASE WHEN north THEN q ELSE (q + 2) % 4 END) = 2 AS INTEGER) AS szn_Summer,
    CAST((CASE WHEN north THEN q ELSE (q + 2) % 4 END) = 3 AS INTEGER) AS szn_Autumn
  FROM f JOIN m USING (sp) JOIN n ON n.id = f.id""")
def observation_features(spark, folder):
    """Cleaning, a join with readings and the whole feature function."""
    from .modelling import observations_with_readings

    raw = settle(clean.complete(clean.dedupe_first(raw_observations(spark, folder))), "first-rows")
    good, _ = clean.split_quality(raw)
    obs = clean.with_local_time(good).drop(
        "quality_grade", "url", "description", "time_observed_at", "time_zone", "input_order")
    ts = times.instant("time_observed_at")
    day = F.date_format(times.to_wall(ts, "time_zone"), "yyyy-MM-dd")
    i = F.col("id")
    readings = raw.select(
        "id", F.col("latitude").alias("lat"), F.col("longitude").alias("long"),
        F.concat(F.substring("time_observed_at", 1, 19), F.lit("+0000")).alias("observed_on"), "time_zone",
        F.when(i % 5 != 0, (i % 100).cast("double")).alias("elevation"), F.lit("").alias("time"),
        F.concat(day, F.lit("T06:10")).alias("sunrise"), F.concat(day, F.lit("T18:20")).alias("sunset"))
    joined = observations_with_readings(obs, readings)
    f = features.general_features(joined, "taxon_species_name", CENTROIDS)
    return with_rounded(f.select(
        "id", "taxon_species_name", "location_cluster", "elevation", "hemisphere", "month", "hour", "light",
        "szn_Spring", "szn_Summer", "szn_Autumn"), "elevation")


@query("zone_counts", f"""WITH {SQL_OBS} SELECT time_zone, count(*) AS n FROM obs GROUP BY 1""")
def zone_counts(spark, folder):
    return value_counts(observations(spark, folder), "time_zone")


