"""Declared schemas of the tables; nothing is inferred from data."""

from pyspark.sql import types as T

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def _fields(spec):
    return T.StructType([T.StructField(n, t, True) for n, t in spec])


# Column names of the tables and of the hourly and daily readings.
TAXON_COLUMNS = [
    "taxon_kingdom_name", "taxon_phylum_name", "taxon_class_name", "taxon_order_name",
    "taxon_family_name", "taxon_genus_name", "taxon_species_name",
]
LEVELS = ["taxon_family_name", "taxon_genus_name", "taxon_species_name", "sub_species"]
LEVEL_WEIGHTS = {"taxon_family_name": 0.1, "taxon_genus_name": 0.2,
                 "taxon_species_name": 0.5, "sub_species": 0.9}
HOURLY = [
    "temperature_2m", "relativehumidity_2m", "dewpoint_2m", "apparent_temperature",
    "surface_pressure", "precipitation", "rain", "snowfall", "cloudcover",
    "cloudcover_low", "cloudcover_mid", "cloudcover_high", "shortwave_radiation",
    "direct_radiation", "diffuse_radiation", "windspeed_10m", "windspeed_100m",
    "winddirection_10m", "winddirection_100m", "windgusts_10m",
    "et0_fao_evapotranspiration", "weathercode", "vapor_pressure_deficit",
    "soil_temperature_0_to_7cm", "soil_temperature_7_to_28cm",
    "soil_temperature_28_to_100cm", "soil_moisture_0_to_7cm",
    "soil_moisture_7_to_28cm", "soil_moisture_28_to_100cm",
]
DAILY = [
    "weathercode", "temperature_2m_max", "temperature_2m_min", "apparent_temperature_max",
    "apparent_temperature_min", "precipitation_sum", "rain_sum", "snowfall_sum",
    "precipitation_hours", "sunrise", "sunset", "windspeed_10m_max", "windgusts_10m_max",
    "winddirection_10m_dominant", "shortwave_radiation_sum", "et0_fao_evapotranspiration",
]
DAILY_TEXT = ["sunrise", "sunset"]
CODES = ["weathercode"]
CLASHING = ["weathercode", "et0_fao_evapotranspiration"]

RAW_OBSERVATIONS = _fields(
    [("id", _L), ("observed_on", _S), ("latitude", _D), ("longitude", _D),
     ("time_observed_at", _S), ("time_zone", _S), ("quality_grade", _S), ("license", _S),
     ("url", _S), ("image_url", _S), ("description", _S), ("positional_accuracy", _D),
     ("public_positional_accuracy", _D), ("geoprivacy", _S), ("taxon_geoprivacy", _S),
     ("scientific_name", _S), ("common_name", _S), ("taxon_id", _L)]
    + [(c, _S) for c in TAXON_COLUMNS])

INTERIM_COLUMNS = [
    "observed_on", "local_time_observed_at", "latitude", "longitude", "positional_accuracy",
    "public_positional_accuracy", "image_url", "license", "geoprivacy", "taxon_geoprivacy",
    "scientific_name", "common_name", "taxon_id",
] + TAXON_COLUMNS

ID_ONLY = _fields([("id", _L)])
BAD_QUALITY = _fields([("id", _L), ("image_url", _S), ("image_quality", _S)])

WEATHER_JOB = _fields([("id", _L), ("latitude", _D), ("longitude", _D), ("obs_time", _S),
                       ("start_date", _S), ("end_date", _S)])


def weather_payload():
    """Nested answer of the weather service: parallel arrays per hour and per day."""
    hourly = [("time", T.ArrayType(_S))] + [
        (n, T.ArrayType(_I if n in CODES else _D)) for n in HOURLY]
    daily = [(n, T.ArrayType(_I if n in CODES else _S if n in DAILY_TEXT else _D)) for n in DAILY]
    return _fields([("timezone", _S), ("elevation", _D),
                    ("hourly", _fields(hourly)), ("daily", _fields(daily))])


def snapshot_name(name, part):
    """Flat column name of a reading; names on both sides get a suffix."""
    return f"{name}_{part}" if name in CLASHING else name


def weather_snapshot():
    """The 52 flat columns of one enriched observation."""
    flat = [("id", _L), ("lat", _D), ("long", _D), ("observed_on", _S), ("time_zone", _S),
            ("elevation", _D), ("time", _S)]
    flat += [(snapshot_name(n, "hourly"), _I if n in CODES else _D) for n in HOURLY]
    flat += [(snapshot_name(n, "daily"),
              _I if n in CODES else _S if n in DAILY_TEXT else _D) for n in DAILY]
    return _fields(flat)


CASCADE_RESULTS = _fields([("id", _L), ("taxonomic_level", _S), ("joint_prediction", _S),
                           ("image_prediction", _S), ("meta_prediction", _S), ("true_label", _S)])
