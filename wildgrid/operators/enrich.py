"""Enrichment: hour lookup in nested readings, zones of points, land flag, joins."""

from pyspark.sql import functions as F, types as T

from ..functions import geo, times
from ..functions.vectors import at_position
from ..schemas import CODES, DAILY, DAILY_TEXT, HOURLY, snapshot_name
from .storage import settle


def join_readings(observations, readings, key="id", drop_left=(), drop_right=()):
    """Inner join on the key after dropping columns that would clash."""
    return observations.drop(*drop_left).join(readings.drop(*drop_right), key, "inner")


def join_with_suffixes(left, right, key, suffixes=("_x", "_y")):
    """Inner join that keeps both of two equally named columns under suffixes."""
    both = [c for c in left.columns if c in right.columns and c != key]
    for c in both:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, key, "inner")


def pick_hour(df, wall, hourly="hourly", names=None):
    """Take the array elements of the hour that holds the local wall time.

    Adds ``time`` and one column per reading; rows without that hour get nulls.
    """
    names = names or HOURLY
    position = F.array_position(F.col(f"{hourly}.time"), times.hour_key(wall))
    return df.withColumn("_at", position).withColumn("time", times.hour_key(wall)).select(
        *df.columns, "time",
        *[at_position(f"{hourly}.{n}", "_at").alias(snapshot_name(n, "hourly")) for n in names])


def snapshots(jobs, payload="payload", obs_time="obs_time", latitude="latitude",
              longitude="longitude", key="id"):
    """(kept, rejected): flat snapshot per job, and reasons for the others.

    The flat rows of ``judged`` are written once with their verdict, so that
    neither result evaluates the 45 lookups again; nothing is shuffled.
    """
    flat = settle(judged(jobs, payload, obs_time, latitude, longitude, key), "snapshots")
    kept = flat.where("reason is null").drop("reason")
    return kept, flat.where("reason is not null").select(key, "reason")


def judged(jobs, payload="payload", obs_time="obs_time", latitude="latitude",
           longitude="longitude", key="id", also=()):
    """Flat row per job with ``reason``, null for a snapshot; columns in ``also`` come along.

    Reasons: no payload, unreadable (text that is not JSON, or without hours),
    no such hour, missing reading.

    The observation's wall time is the text before its offset; the hour must be
    among the payload's hours and every numeric reading must be present.
    """
    wall = F.try_to_timestamp(F.substring(obs_time, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    hour = times.hour_key(wall)
    p = F.col(payload)
    position = F.array_position(p["hourly"]["time"], hour)
    hourly = [at_position(p["hourly"][n], "_at").try_cast("int" if n in CODES else "double")
              .alias(snapshot_name(n, "hourly")) for n in HOURLY]
    daily = [F.get(p["daily"][n], F.lit(0))
             .try_cast("string" if n in DAILY_TEXT else "int" if n in CODES else "double")
             .alias(snapshot_name(n, "daily")) for n in DAILY]
    flat = jobs.withColumn("_at", position).select(
        F.col(key), F.col(latitude).alias("lat"), F.col(longitude).alias("long"),
        F.col(obs_time).alias("observed_on"), p["timezone"].alias("time_zone"),
        p["elevation"].alias("elevation"), hour.alias("time"), *hourly, *daily, *also,
        p.isNull().alias("_no_payload"), p["hourly"].isNull().alias("_unreadable"), F.coalesce(F.col("_at") == 0, F.lit(True)).alias("_no_hour"))
    needed = [snapshot_name(n, "hourly") for n in HOURLY] + \
             [snapshot_name(n, "daily") for n in DAILY if n not in DAILY_TEXT]
    missing = F.lit(False)
    for n in needed:
        missing = missing | F.col(n).isNull()
    reason = (F.when(F.col("_no_payload"), "no payload").when(F.col("_unreadable"), "unreadable")
              .when(F.col("_no_hour"), "no such hour")
              .when(missing, "missing reading"))
    return flat.withColumn("reason", reason).drop("_no_payload", "_unreadable", "_no_hour")


def error_counts(rejected):
    """Number of rejected jobs by reason."""
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("errors"))


def corrected_jobs(jobs, day_of_month_only=False):
    """Ask for the observed day where a job's start day differs from it."""
    wall = F.try_to_timestamp(F.substring("obs_time", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    start = times.strict_date("start_date")
    day = times.corrected_day(start, wall, day_of_month_only)
    changed = ~day.eqNullSafe(start)
    end = F.when(changed, day).otherwise(times.strict_date("end_date"))
    return jobs.withColumn("_end", F.date_format(end, "yyyy-MM-dd")) \
               .withColumn("start_date", F.date_format(day, "yyyy-MM-dd")) \
               .withColumn("end_date", F.col("_end")).drop("_end")


def hour_join(points, hours, key, wall, hour="hour"):
    """Point-in-time equi join with a table of hourly readings (key, hour, ...)."""
    return points.withColumn(hour, times.hour_key(wall)).join(hours, [key, hour], "inner")


def _edges(ring):
    """Edges of a closed ring; one that crosses the date line comes twice.

    Longitudes of such a ring are unwrapped (negative ones 360 further east), and
    its edges are given there and 360 degrees further west, so that points on
    both sides of the line find them.
    """
    def jump(i):
        return F.abs(F.get(ring, i)["lon"] - F.get(ring, i - 1)["lon"]) > 180

    def edge(lon, shift):
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
            (lon(F.get(ring, i - 1)["lon"]) + shift).cast("double").alias("x1"),
            F.get(ring, i - 1)["lat"].cast("double").alias("y1"),
            (lon(F.get(ring, i)["lon"]) + shift).cast("double").alias("x2"),
            F.get(ring, i)["lat"].cast("double").alias("y2")))

    def unwrapped(x):
        return F.when(x < 0, x + 360).otherwise(x)

    crosses = F.exists(F.sequence(F.lit(1), F.size(ring) - 1), jump)
    return F.when(crosses, F.concat(edge(unwrapped, 0), edge(unwrapped, -360))).otherwise(edge(lambda x: x, 0))


def polygon_cells(zones, zone="zone", ring="ring", per_degree=1):
    """Grid index of a polygon table: one row per cell with its candidates.

    ``ring`` is a closed array of struct(lon, lat), or an array of such rings:
    the parts of a zone and the holes in them, in any order. A point is inside
    if it is inside an odd number of rings. Rings may cross the date line. A
    cell keeps only the edges a ray towards east can meet from inside the cell,
    so long borders are not copied whole into every cell; finer cells
    (``per_degree``) hold fewer edges where borders are dense.
    """
    single = isinstance(zones.schema[ring].dataType.elementType, T.StructType)
    rings = F.array(F.col(ring)) if single else F.col(ring)
    edge = F.flatten(F.transform(rings, _edges))

    def span(ends, pick, least, most):
        low = pick(F.flatten(F.transform("edges", lambda e: F.array(e[ends[0]], e[ends[1]]))))
        cell = F.floor(low * per_degree).cast("int")
        return F.least(F.lit(most * per_degree - 1), F.greatest(F.lit(least * per_degree), cell))

    base = zones.select(F.col(zone).alias("zone"), edge.alias("edges"))
    base = base.select("zone", "edges", span(("y1", "y2"), F.array_min, -90, 91).alias("s"),
                       span(("y1", "y2"), F.array_max, -90, 91).alias("n"),
                       span(("x1", "x2"), F.array_min, -180, 181).alias("w"),
                       span(("x1", "x2"), F.array_max, -180, 181).alias("e"))
    base = base.withColumn("cell_lat", F.explode(F.sequence("s", "n")))
    south, north = F.col("cell_lat") / per_degree, (F.col("cell_lat") + 1) / per_degree
    band = F.filter("edges", lambda x: (F.greatest(x.y1, x.y2) >= south) &
                    (F.least(x.y1, x.y2) <= north))
    base = base.withColumn("edges", band).withColumn("cell_lon", F.explode(F.sequence("w", "e")))
    west = F.col("cell_lon") / per_degree
    base = base.withColumn("edges", F.filter("edges", lambda x: F.greatest(x.x1, x.x2) >= west))
    base = base.where(F.size("edges") > 0)
    return settle(base.groupBy("cell_lat", "cell_lon").agg(
        F.array_sort(F.collect_list(F.struct("zone", "edges"))).alias("zones")), "cells")


def zone_of_point(df, cells, latitude="latitude", longitude="longitude", name="time_zone",
                  per_degree=1):
    """Overwrite or add the zone that holds each point; null outside all zones.

    Every point meets at most one cell row, so no row is multiplied and nothing
    has to be deduplicated. Overlapping zones: the first name wins.
    """
    lat, lon = geo.grid_cell(latitude, longitude, per_degree)
    keyed = df.drop(name).withColumn("cell_lat", lat).withColumn("cell_lon", lon)
    joined = keyed.join(cells, ["cell_lat", "cell_lon"], "left")
    hit = F.filter("zones", lambda z: geo.inside(z["edges"], latitude, longitude))
    return joined.withColumn(name, F.get(hit, F.lit(0))["zone"]).select(*keyed.columns[:-2], name)


def land_flag(df, land_grid, latitude="latitude", longitude="longitude", per_degree=1, name="land"):
    """1 or 0 from a grid of land cells; cells that are not listed are water."""
    lat, lon = geo.grid_cell(latitude, longitude, per_degree)
    keyed = df.drop(name).withColumn("cell_lat", lat).withColumn("cell_lon", lon)
    grid = land_grid.select("cell_lat", "cell_lon", F.col("land").alias(name))
    return keyed.join(grid, ["cell_lat", "cell_lon"], "left") \
                .withColumn(name, F.coalesce(F.col(name), F.lit(0))) \
                .drop("cell_lat", "cell_lon")
