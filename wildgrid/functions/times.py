"""Dates, instants and wall clocks as column expressions.

Timestamps are instants (session zone UTC); a wall clock is the same type
shifted by ``from_utc_timestamp`` and always travels with its zone column.
"""

from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

from .text import _col


@lru_cache(maxsize=None)
def zones():
    """Zone names that Spark's own zone data can convert; others would fail a job."""
    jvm = SparkSession.active().sparkContext._jvm
    names = {str(z) for z in jvm.java.time.ZoneId.getAvailableZoneIds()}
    return tuple(sorted(names | {str(z) for z in jvm.java.time.ZoneId.SHORT_IDS.keySet()}))


def strict_date(column):
    """``yyyy-MM-dd`` or null, never an error."""
    c = _col(column)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def instant(column):
    """``yyyy-MM-dd HH:mm:ss`` followed by ``UTC`` or an offset, or null."""
    c = _col(column)
    plain = F.regexp_replace(c, r"\s*(UTC|Z)$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssxx")),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssx")),
    )


def wall_time(column):
    """Naive ``yyyy-MM-ddTHH:mm`` or null."""
    return F.try_to_timestamp(_col(column), F.lit("yyyy-MM-dd'T'HH:mm"))


def known_zone(zone):
    """True for zone names that can be converted without failing (a hash set)."""
    if isinstance(zone, str):
        # One parsed text instead of a driver call for each of the names.
        listed = ", ".join(f"'{z}'" for z in zones())
        return F.expr(f"coalesce(`{zone}` IN ({listed}), false)")
    return F.coalesce(zone.isin(*zones()), F.lit(False))


def to_wall(ts, zone):
    """Instant -> wall clock of the row's own zone; null for an unknown zone."""
    return F.when(known_zone(zone), F.from_utc_timestamp(_col(ts), _col(zone)))


def to_instant(wall, zone):
    """Wall clock of the row's own zone -> instant; null for an unknown zone."""
    return F.when(known_zone(zone), F.to_utc_timestamp(_col(wall), _col(zone)))


def offset_text(ts, wall):
    """``+HH:MM`` between an instant and its wall clock."""
    minutes = F.floor((F.unix_timestamp(_col(wall)) - F.unix_timestamp(_col(ts))) / 60)
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"))


def local_time_text(ts, zone):
    """Local time with its offset, as in ``2022-08-02 00:40:00+10:00``."""
    wall = to_wall(ts, zone)
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), offset_text(ts, wall))


def local_hour(ts, zone):
    return F.hour(to_wall(ts, zone))


def utc_month(ts):
    return F.month(_col(ts))


def hour_key(wall):
    """Wall clock floored to the hour, as the enrichment payload writes it."""
    return F.date_format(F.date_trunc("hour", _col(wall)), "yyyy-MM-dd'T'HH:mm")


def daylight(ts, sunrise, sunset, zone, local_mean_minutes=None):
    """1 when the instant lies between local sunrise and sunset, both included.

    ``local_mean_minutes`` replaces the zone rules by a fixed offset column, for
    comparison with results that used each zone's local mean time.
    """
    if local_mean_minutes is None:
        rise, down = to_instant(sunrise, zone), to_instant(sunset, zone)
    else:
        shift = F.make_dt_interval(F.lit(0), F.lit(0), _col(local_mean_minutes))
        rise, down = _col(sunrise) - shift, _col(sunset) - shift
    return _col(ts).between(rise, down).cast("int")


def corrected_day(start, observed_wall, day_of_month_only=False):
    """Day to ask for: the observed day wherever the job's start day differs."""
    s, o = _col(start), F.to_date(_col(observed_wall))
    differs = (F.dayofmonth(s) != F.dayofmonth(o)) if day_of_month_only else (s != o)
    return F.when(differs, o).otherwise(s)
