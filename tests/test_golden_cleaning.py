"""Eight raw rows with planted faults and their known results."""

import pytest
from pyspark.sql import functions as F

from wildgrid.operators import clean, enrich
from wildgrid.plans.cleaning import clean_batch
from wildgrid.schemas import INTERIM_COLUMNS, RAW_OBSERVATIONS
from wildgrid.sources.readers import from_rows

# id, date, latitude, longitude, time, remark
ROWS = [
    (128984633, "2022-08-02", -30.4900714453, 151.6392706226, "2022-08-01 14:40:00 UTC", ""),
    (129051266, "2022-08-02", 43.1196234274, -7.6788841188, "2022-08-01 22:20:13 UTC", ""),
    (129054418, "2022-08/02", 50.6864393301, 7.1697807312, "2022-08-01 22:26:13 UTC", ""),
    (129076855, "2022-08-02", -40.9498116654, 174.9710916171, "2022-08-02 01:32:23 UTC", ""),
    (129076855, "2022-08-02", -40.9498116654, 174.9710916171, "2022-08-02 01:32:23 UTC",
     "Really bad picture but there is one in there"),
    (129107609, "202g-08-02", 43.952764223, -110.6115040714, "2022-08-02 07:14:59 UTC", ""),
    (129120635, "2022-08-02", -18.83915, 16.9536, "2022-08-02 08:11:57 UTC", None),
    (38197744, "2020-02-02", -38.1974245434, 145.4793232007, "2020-02-01 23:04:35 UTC",
     "Caught in a trap along the fence"),
]
ZONES = {
    "Australia/Sydney": (149, -37, 153, -29), "Europe/Madrid": (-9.5, 36, 3, 43.9),
    "Europe/Berlin": (6, 47.5, 15, 55), "Pacific/Auckland": (166, -47, 178.9, -34),
    "America/Denver": (-114, 31.3, -102.1, 49), "Africa/Windhoek": (12, -29, 20.9, -17),
    "Australia/Melbourne": (141, -39, 149, -34.5),
}


@pytest.fixture(scope="module")
def raw(spark):
    base = {f.name: None for f in RAW_OBSERVATIONS.fields}
    rows = [tuple({**base, "id": i, "observed_on": d, "latitude": a, "longitude": o, "time_observed_at": t,
                   "time_zone": "Sydney", "description": r, "image_url": f"photo{n}", "taxon_id": n}.values())
            for n, (i, d, a, o, t, r) in enumerate(ROWS)]
    return from_rows(spark, rows, RAW_OBSERVATIONS).withColumn("input_order", F.col("taxon_id"))


@pytest.fixture(scope="module")
def cells(spark):
    def ring(w, s, e, n):
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]
    rows = [(z, [tuple(map(float, p)) for p in ring(*box)]) for z, box in ZONES.items()]
    zones = spark.createDataFrame(rows, "zone string, ring array<struct<lon double, lat double>>")
    return enrich.polygon_cells(zones)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_unique_ids_keep_the_first(raw):
    kept = clean.dedupe_first(raw)
    assert ids(kept) == sorted({r[0] for r in ROWS})
    assert kept.where("id = 129076855").first()["image_url"] == "photo3"


def test_resume(spark, raw):
    done = spark.createDataFrame([(128984633,), (38197744,)], "id long")
    bad = spark.createDataFrame([(129051266,)], "id long")
    assert ids(clean.without(clean.dedupe_first(raw), done, bad)) == [
        129054418, 129076855, 129107609, 129120635]


def test_dates(raw):
    dates = sorted(str(r[0]) for r in clean.valid_dates(raw).select("observed_on").collect())
    assert dates == ["2020-02-02"] + ["2022-08-02"] * 5


def test_zones(raw, cells):
    got = {(r["id"], r["time_zone"]) for r in enrich.zone_of_point(raw, cells).collect()}
    assert got == {
        (128984633, "Australia/Sydney"), (129051266, "Europe/Madrid"), (129054418, "Europe/Berlin"),
        (129076855, "Pacific/Auckland"), (129107609, "America/Denver"), (129120635, "Africa/Windhoek"),
        (38197744, "Australia/Melbourne")}


def test_local_times(raw, cells):
    df = clean.with_local_time(enrich.zone_of_point(raw, cells))
    got = sorted(r[0] for r in df.select("local_time_observed_at").collect())
    assert got == sorted([
        "2022-08-02 00:40:00+10:00", "2022-08-02 00:20:13+02:00", "2022-08-02 00:26:13+02:00",
        "2022-08-02 13:32:23+12:00", "2022-08-02 13:32:23+12:00", "2022-08-02 01:14:59-06:00",
        "2022-08-02 10:11:57+02:00", "2020-02-02 10:04:35+11:00"])


def test_quarantine(raw):
    good, bad = clean.split_quality(raw)
    assert ids(bad) == [38197744, 129076855]
    assert ids(good) == [128984633, 129051266, 129054418, 129076855, 129107609, 129120635]
    assert clean.quarantine(bad).columns == ["id", "image_url", "image_quality"]


def test_whole_flow(raw, cells):
    good, bad = clean_batch(raw, cells)
    assert good.columns == ["id"] + INTERIM_COLUMNS
    assert ids(good) == [128984633, 129051266, 129076855, 129120635]
    assert ids(bad) == [38197744]  # the repeated id lost its second row before


def test_null_gate_and_empty_input(raw):
    assert clean.complete(raw.withColumn("latitude", F.lit(None).cast("double"))).count() == 0
    with pytest.raises(clean.NothingToDo):
        clean.require_rows(raw.where("id < 0"))


def test_keywords_inside_words(spark):
    df = spark.createDataFrame([("a badger",), ("whirlpool",), ("nice",), (None,), ("ROAD side",)], "description string")
    flags = [r["is_bad"] for r in clean.flag_poor_quality(df).collect()]
    assert flags == [True, True, False, False, True]
    flags = [r["is_bad"] for r in clean.flag_poor_quality(df, whole_words=True).collect()]
    assert flags == [False, False, False, False, True]
