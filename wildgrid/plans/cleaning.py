"""The cleaning job: lazy plan from raw observations to clean and quarantined rows."""

from pyspark.sql import functions as F

from ..operators import clean, enrich
from ..operators.storage import settle, steps_removed
from ..schemas import BAD_QUALITY, ID_ONLY, RAW_OBSERVATIONS
from ..sources.readers import read_csv
from ..sources import targets


def clean_batch(raw, cells=None, done=(), order="input_order", words=None):
    """(clean, quarantine) of raw rows.

    The keyword split comes before the date check, so a row with both faults is
    quarantined. Ids done before are left out first: that and the choice of the
    first row per id do not depend on each other. ``cells``: grid index of time zones; without it the rows' own
    ``time_zone`` is used. The flagged rows are written once and read twice.
    """
    fresh = clean.without(raw, *done)
    rows = clean.dedupe_first(fresh, "id", order) if order else fresh
    rows = clean.complete(rows)
    flagged = settle(clean.flag_poor_quality(rows, words=words), "flagged")
    good = clean.valid_dates(flagged.where(~F.col("is_bad")))
    if cells is not None:
        good = enrich.zone_of_point(good, cells)
    bad = flagged.where("is_bad").withColumn("image_quality", F.lit("bad"))
    return clean.interim(clean.with_local_time(good)), clean.quarantine(bad)


def clean_files(spark, paths, out, cells=None, **options):
    """Run the job on CSV files and append to ``out/interim`` and ``out/bad_quality``.

    Ids found in either output are skipped, and both outputs of a run appear
    together or not at all, so an interrupted run is repeated without harm.
    Read them with ``targets.read``.
    """
    raw = read_csv(spark, paths, RAW_OBSERVATIONS, keep_order=True, **options)
    bad_done = targets.read(spark, out, "bad_quality", BAD_QUALITY).select("id")
    ok_done = targets.read(spark, out, "interim", ID_ONLY).select("id")
    with steps_removed(spark):
        good, bad = clean_batch(raw, cells, [ok_done, bad_done])
        targets.commit_together(spark, out, {"bad_quality": (bad, "id"), "interim": (good, "id")})
