"""Tables of geolocated, time-stamped observations on Spark: clean, enrich,
derive features, profile, sample, train per node and score level by level."""

__version__ = "0.1.0"
