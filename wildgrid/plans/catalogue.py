"""Named queries with the SQL that checks them."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, with SQL where SQL can say it."""
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return keep


def load():
    """Import the modules that register queries; returns (queries, oracles)."""
    from . import (queries_clean, queries_enrich, queries_learn, queries_metrics,  # noqa: F401
                   queries_profile, queries_sampling, queries_cascade, queries_more)
    return dict(QUERIES), dict(ORACLES)
