"""Feature columns for learning, as expressions over the joined observations."""

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import functions as F

from ..functions import geo, times, vectors
from ..functions.text import trinomial
from ..schemas import TAXON_COLUMNS
from .clean import complete, well_located
from .profile import impute_group_mean, large_classes
from .storage import bounded_rows, settle

DROPPED = ["geoprivacy", "taxon_geoprivacy", "taxon_id", "license", "image_url"]
# The numeric readings that are standardised for a network.
STANDARDISED = [
    "apparent_temperature", "apparent_temperature_max", "apparent_temperature_min",
    "cloudcover", "cloudcover_high", "cloudcover_low", "cloudcover_mid", "dewpoint_2m",
    "diffuse_radiation", "direct_radiation", "elevation", "et0_fao_evapotranspiration_daily",
    "et0_fao_evapotranspiration_hourly", "precipitation", "precipitation_hours",
    "precipitation_sum", "rain", "rain_sum", "relativehumidity_2m", "shortwave_radiation",
    "shortwave_radiation_sum", "snowfall", "snowfall_sum", "soil_moisture_0_to_7cm",
    "soil_moisture_28_to_100cm", "soil_moisture_7_to_28cm", "soil_temperature_0_to_7cm",
    "soil_temperature_28_to_100cm", "soil_temperature_7_to_28cm", "surface_pressure",
    "temperature_2m", "temperature_2m_max", "temperature_2m_min", "vapor_pressure_deficit",
    "winddirection_100m", "winddirection_10m", "winddirection_10m_dominant",
    "windgusts_10m", "windgusts_10m_max", "windspeed_100m", "windspeed_10m",
    "windspeed_10m_max",
]


def fixed_dummies(df, column, categories, prefix):
    """0/1 columns for fixed categories, the first one left out."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[
        F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)).alias(f"{prefix}_{c}")
        for c in categories[1:]])


def fit_categories(df, column, limit=10000):
    """Sorted categories of a training column; a fitted encoder is this list."""
    rows = bounded_rows(df.where(F.col(column).isNotNull()).select(column).distinct(),
                        limit, f"categories of {column}")
    return sorted(r[0] for r in rows)


def fit_scaler(df, columns):
    """{column: (mean, population deviation)}; constant columns get deviation 1."""
    aggregates = [f(c).alias(f"{c}|{n}") for c in columns
                  for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    row = df.agg(*aggregates).first()
    return {c: (row[f"{c}|m"], row[f"{c}|s"] or 1.0) for c in columns}


def standardise(df, scaler):
    """Subtract the mean, divide by the deviation."""
    return df.select(*[((F.col(c) - scaler[c][0]) / scaler[c][1]).alias(c) if c in scaler
                       else F.col(c) for c in df.columns])


def location_cluster(df, clusters, latitude="latitude", longitude="longitude"):
    """Add the nearest centroid's number; ``clusters``: list of centres or a fitted model."""
    if hasattr(clusters, "clusterCenters"):
        clusters = clusters.clusterCenters()
    return df.withColumn("location_cluster",
                         vectors.nearest([latitude, longitude], [list(c) for c in clusters]))


def with_subspecies(df, exclude_hybrids=False):
    return df.withColumn("sub_species", trinomial("scientific_name", exclude_hybrids))


def calendar(df):
    """month (UTC), hour (local), light, season from instant, zone and sun times."""
    ts = times.instant("observed_on")
    df = df.withColumn("observed_on", ts).withColumn("month", times.utc_month("observed_on")) \
           .withColumn("hour", times.local_hour("observed_on", "time_zone")) \
           .withColumn("sunrise", times.wall_time("sunrise")) \
           .withColumn("sunset", times.wall_time("sunset"))
    df = complete(df, ["sunrise", "sunset"])
    df = df.withColumn("light", times.daylight("observed_on", "sunrise", "sunset", "time_zone"))
    return df.withColumn("season", geo.season("month", "hemisphere")).drop("sunrise", "sunset")


def derived_columns(df, clusters, impute_by="taxon_species_name", means=None):
    """Place, elevation, calendar, light and season columns of cleaned rows."""
    df = location_cluster(df, clusters)
    if "land" not in df.columns:
        df = df.withColumn("land", F.lit(1))
    df = df.withColumn("elevation", geo.real_elevation("elevation", "land"))
    df = impute_group_mean(df, "elevation", impute_by, means)
    df = df.withColumn("hemisphere", geo.hemisphere("latitude")).drop("latitude", "longitude")
    return fixed_dummies(calendar(df), "season", geo.SEASONS, "szn")


def general_features(df, target, clusters, min_size=5, limit=40000,
                     impute_by="taxon_species_name", means=None):
    """Joined observations -> cleaned training rows with all derived features.

    Row filters come first, class sizes are taken after them, as the result
    depends on that order. The filtered rows are written once; the passes for
    class sizes and group means then read two or three columns of them. A
    ``land`` column (see ``land_flag``) is used where the table has one.
    """
    df = df.drop(*DROPPED)
    df = complete(df, ["taxon_species_name", "public_positional_accuracy"])
    df = well_located(df, limit).drop("public_positional_accuracy")
    df = settle(with_subspecies(df).drop("scientific_name"), "observations")
    return derived_columns(large_classes(df, target, min_size), clusters, impute_by, means)


def scoring_features(df, clusters, means, impute_by="taxon_species_name", limit=40000):
    """The same columns for rows to be scored: nothing is learned from them.

    ``means`` (group, mean) come from training rows; no class is left out.
    """
    df = well_located(df.drop(*DROPPED), limit).drop("public_positional_accuracy")
    df = with_subspecies(df).drop("scientific_name")
    return derived_columns(df, clusters, impute_by, means)


def feature_columns(df, key="id"):
    """Columns that are features: neither key, label nor text time."""
    labels = {key, "observed_on", "time_zone", "sub_species", "common_name", *TAXON_COLUMNS}
    return [c for c in df.columns if c not in labels]


def split_xy(df, target, features, key="id"):
    """(features with key, label with key) of rows that have a label."""
    known = df.na.drop(subset=[target])
    return known.select(key, *features), known.select(key, target)


def network_features(df, target, key="id", encoders=None, scaler=None, max_categories=10_000):
    """Dummies for cluster, hour and month, then standardised readings.

    Returns (table, encoders, scaler); pass the fitted two when scoring, so
    that training and scoring have the same columns. A column with more than
    ``max_categories`` values stops the job: each of them becomes a column.
    """
    plan = {"location_cluster": "loc", "hour": "hr", "month": "mnth"}
    if encoders is None:
        encoders = {c: fit_categories(df, c, max_categories) for c in plan}
    for c, prefix in plan.items():
        df = fixed_dummies(df, c, encoders[c], prefix)
    present = [c for c in STANDARDISED if c in df.columns]
    scaler = scaler or fit_scaler(df, present)
    return standardise(df, scaler), encoders, scaler


def fit_label_index(df, label, name="label_index"):
    """Label -> number by alphabetical order."""
    return StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc",
                         handleInvalid="skip").fit(df)


def label_names(df, index, labels, name="label"):
    """Number -> label."""
    return IndexToString(inputCol=index, outputCol=name, labels=list(labels)).transform(df)


def label_vector(df, label, classes, name="label_vector"):
    """One 0/1 entry per class in alphabetical order, two entries for two classes."""
    cells = [(F.col(label) == F.lit(c)).cast("int") for c in sorted(classes)]
    return df.withColumn(name, F.array(*cells))
