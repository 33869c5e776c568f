import math

import pytest
from pyspark.sql import functions as F

from wildgrid.functions import geo, hashing, text, times, vectors
from wildgrid.operators import enrich


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_all_months_and_hemispheres(spark):
    north = ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer",
             "Autumn", "Autumn", "Autumn", "Winter"]
    turn = {"Winter": "Summer", "Summer": "Winter", "Spring": "Autumn", "Autumn": "Spring"}
    df = spark.range(24).select((F.col("id") % 12 + 1).alias("m"), (F.col("id") < 12).cast("int").alias("n"))
    for r in df.select("m", "n", geo.season("m", "n").alias("s")).collect():
        expected = north[r["m"] - 1]
        assert r["s"] == (expected if r["n"] == 1 else turn[expected])


def test_names(spark):
    df = spark.createDataFrame([("Panthera leo",), ("  Puma concolor  couguar ",), (None,), ("A b × c",)], "c string")
    got = [r[0] for r in df.select(text.trinomial("c")).collect()]
    assert got == [None, "  Puma concolor  couguar ", None, "A b × c"]
    got = [r[0] for r in df.select(text.trinomial("c", exclude_hybrids=True)).collect()]
    assert got == [None, "  Puma concolor  couguar ", None, None]
    row = one(spark, text.node_key(F.lit("Puma Concolor x")), text.capitalise(F.lit("big_CAT name")),
              text.drop_tail(F.lit("123_a.jpg"), 6), text.drop_tail(F.lit("ab"), 6))
    assert tuple(row) == ("puma_concolor_x", "Big cat name", "123", "")
    assert text.columns_matching(spark.range(1).selectExpr("1 as a_max", "2 as b"), "max$") == ["a_max"]


def test_times(spark):
    day = lambda s: times.strict_date(F.lit(s))
    assert [str(x) for x in one(spark, day("2022-08-02"), day("2022-8-2"), day("202g-01-01"), day("2022-02-30"))] \
        == ["2022-08-02", "None", "None", "None"]
    forms = ["2022-08-01 14:40:00 UTC", "2022-08-01 14:40:00+00:00", "2022-08-01 16:40:00+0200",
             "2022-08-01 16:40:00+02", "broken"]
    got = one(spark, *[F.date_format(times.instant(F.lit(f)), "HH:mm") for f in forms])
    assert list(got) == ["14:40"] * 4 + [None]
    df = spark.createDataFrame([("Africa/Johannesburg",), ("No/Zone",), (None,)], "z string") \
        .withColumn("w", F.lit("2022-01-05T06:10"))
    got = [r[0] for r in df.select(F.date_format(times.to_instant(times.wall_time("w"), "z"), "HH:mm")).collect()]
    assert got == ["04:10", None, None]


def test_daylight_by_local_mean_time(spark):
    df = spark.createDataFrame([("2022-01-05 04:15:00 UTC", "2022-01-05T06:10", "2022-01-05T18:00",
                                 "Africa/Johannesburg", 112)], "t string, r string, s string, z string, m int")
    args = (times.instant("t"), times.wall_time("r"), times.wall_time("s"), F.col("z"))
    assert df.select(times.daylight(*args)).first()[0] == 1          # 04:10 to 16:00
    assert df.select(times.daylight(*args, "m")).first()[0] == 0     # 04:18 to 16:08


def test_corrected_days(spark):
    rows = [(1, 0.0, 0.0, "2022-03-02 00:10:00+02:00", "2022-03-01", "2022-03-02"),
            (2, 0.0, 0.0, "2022-03-02 09:00:00+02:00", "2022-03-02", "2022-03-03"),
            (3, 0.0, 0.0, "2022-03-02 09:00:00+02:00", "2022-02-02", "2022-02-02")]
    jobs = spark.createDataFrame(rows, "id long, latitude double, longitude double, obs_time string, "
                                       "start_date string, end_date string")
    got = {r["id"]: (r["start_date"], r["end_date"]) for r in enrich.corrected_jobs(jobs).collect()}
    assert got == {1: ("2022-03-02", "2022-03-02"), 2: ("2022-03-02", "2022-03-03"), 3: ("2022-03-02", "2022-03-02")}
    got = {r["id"]: r["start_date"] for r in enrich.corrected_jobs(jobs, day_of_month_only=True).collect()}
    assert got[3] == "2022-02-02"


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = one(spark, vectors.blend(a(0.2, 0.8), a(0.6, 0.4), F.lit(0.25)), vectors.first_max(a(1, 3, 3)),
              vectors.normalise(a(0, 0)), vectors.pick(F.array(F.lit("x"), F.lit("y")), a(1, 2)))
    assert row[0] == pytest.approx([0.5, 0.5])
    assert (row[1], row[2], row[3]) == (1, None, "y")
    row = one(spark, vectors.nearest([F.lit(0.0), F.lit(0.0)], [[1, 0], [0, 1], [5, 5]]))
    assert row[0] == 0


def test_hash_is_even_and_repeatable(spark):
    df = spark.range(20000).select(hashing.hash_unit("id", 5).alias("u"))
    mean, spread = df.agg(F.avg("u"), F.stddev("u")).first()
    assert abs(mean - 0.5) < 0.01 and abs(spread - 1 / math.sqrt(12)) < 0.01
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_concave_polygon_over_many_cells(spark):
    ring = [(0.5, 0.5), (6.5, 0.5), (6.5, 6.5), (3.5, 2.5), (0.5, 6.5), (0.5, 0.5)]
    zones = spark.createDataFrame([("z", [(float(x), float(y)) for x, y in ring])],
                                  "zone string, ring array<struct<lon double, lat double>>")
    cells = enrich.polygon_cells(zones)
    n = 40
    points = spark.range(n * n).select(
        "id", (F.col("id") % n * 0.2 + 0.07).alias("longitude"), (F.floor(F.col("id") / n) * 0.2 + 0.03).alias("latitude"))

    def brute(x, y):
        inside = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
        return inside

    got = enrich.zone_of_point(points, cells).collect()
    assert len(got) == n * n
    for r in got:
        assert (r["time_zone"] == "z") == brute(r["longitude"], r["latitude"])
    finer = enrich.polygon_cells(zones, per_degree=3)
    again = enrich.zone_of_point(points, finer, per_degree=3)
    assert {(r["id"], r["time_zone"]) for r in again.collect()} == {(r["id"], r["time_zone"]) for r in got}
