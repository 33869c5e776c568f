"""From joined observations to features, models and scores."""

from ..operators import cluster, features, train
from ..operators.clean import differs
from ..operators.enrich import join_readings
from ..operators.metrics import balanced_accuracy, class_report, pair_counts
from ..operators.sampling import stratified_split
from ..schemas import LEVELS

OBSERVATION_DROPS = ["observed_on", "local_time_observed_at", "positional_accuracy"]
READING_DROPS = ["lat", "long", "time"]


def observations_with_readings(observations, readings, excluded_species=None):
    """Inner join on id with sub-species labels, without an excluded species."""
    df = join_readings(observations, readings, "id", OBSERVATION_DROPS, READING_DROPS)
    if excluded_species:
        df = df.where(differs("taxon_species_name", excluded_species))
    return features.with_subspecies(df)


def node_features(df, target, ks=range(4, 61, 2), restarts=10):
    """Location clusters for the rows of a node, then all features."""
    points = cluster.distinct_points(df)
    model, scores = cluster.choose_k(points, ks, restarts)
    return features.general_features(df, target, model), model, scores


def training_rows(df, target, kind, holdout=0.2, key="id", encoders=None, scaler=None):
    """(training rows, holdout rows, feature names, (encoders, scaler)) for a model kind.

    Trees take the derived columns as they are; a network gets dummies and
    standardised readings, fitted on the rows given here unless passed in.
    """
    fitted = (None, None)
    if kind == "network":
        df, *fitted = features.network_features(df, target, key, encoders, scaler)
    names = features.feature_columns(df, key)
    split = stratified_split(df.na.drop(subset=[target]), target, key, holdout)
    kept = [key, target, *names]
    return (split.where("not is_holdout").select(*kept), split.where("is_holdout").select(*kept),
            names, tuple(fitted))


def sweep_reports(predictions):
    """Per-class report and balanced accuracy for every (level, kind, node)."""
    by = ["level", "kind", "node"]
    pairs = pair_counts(predictions, "true_label", "prediction", by)
    return class_report(pairs, by, with_unseen=False), balanced_accuracy(pairs, by)


def train_all(df, kinds, feature_names, root=False, **options):
    """Models for all nodes below the families, or the root above them."""
    target = LEVELS[0] if root else None
    return train.sweep(df, LEVELS, feature_names, kinds, root_target=target, **options)
