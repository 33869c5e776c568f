"""Features of joined rows: training rows, scoring rows, network columns."""

import pytest
from pyspark.sql import functions as F

from wildgrid.operators import clean, enrich, features, profile
from wildgrid.plans import modelling
from wildgrid.plans.adapter import raw_observations, weather_jobs
from wildgrid.plans.queries_enrich import CENTROIDS


@pytest.fixture(scope="module")
def joined(spark, small):
    raw = clean.complete(clean.dedupe_first(raw_observations(spark, small)))
    obs = clean.with_local_time(clean.split_quality(raw)[0]).drop(
        "quality_grade", "url", "description", "time_observed_at", "time_zone", "input_order")
    kept, _ = enrich.snapshots(weather_jobs(spark, small))
    kept = kept.withColumn("time_zone", F.lit("Australia/Sydney"))
    return modelling.observations_with_readings(obs, kept, excluded_species="Genus0 view").cache()


def test_join_has_the_known_width(joined):
    # 17 observation and 48 reading columns, key and sub-species
    assert len(joined.columns) == 17 + 48 + 2
    assert joined.where("taxon_species_name = 'Genus0 view'").count() == 0


def test_53_features(spark, joined):
    table = features.general_features(joined, "taxon_species_name", CENTROIDS)
    names = features.feature_columns(table)
    assert len(names) == 53
    assert table.count() > 100
    audit = profile.null_audit(table, names).where("has_null")
    assert audit.count() == 0
    train, held, used, _ = modelling.training_rows(table, "taxon_species_name", "tree")
    assert used == names and train.count() + held.count() == table.count()
    wide, _, more, fitted = modelling.training_rows(table, "taxon_species_name", "network")
    assert len(more) > 53 and set(fitted[0]) == {"location_cluster", "hour", "month"}
    x, y = features.split_xy(wide.withColumn("extra", F.lit(1)), "taxon_species_name", more)
    assert x.columns == ["id", *more] and y.columns == ["id", "taxon_species_name"]


def test_scoring_uses_training_means(spark, joined):
    means = spark.createDataFrame([(n, 7.0) for n in ("Genus1 view", "Genus2 view")],
                                  "taxon_species_name string, mean double")
    rows = joined.withColumn("elevation", F.lit(0.0)).where("taxon_species_name like '% view'")
    got = features.scoring_features(rows, CENTROIDS, means).groupBy("elevation").count().collect()
    assert [r["elevation"] for r in got] == [7.0]
    water = rows.withColumn("land", F.lit(0))
    got = features.scoring_features(water, CENTROIDS, means).groupBy("elevation").count().collect()
    assert [r["elevation"] for r in got] == [0.0]
