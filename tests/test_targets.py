"""Several targets, one commit: all rows of a batch or none, each key once."""

import pytest
from pyspark.sql import functions as F

from wildgrid.schemas import ID_ONLY
from wildgrid.sources import targets


def batch(spark, low, high):
    rows = spark.range(low, high)
    return {"even": (rows.where("id % 2 = 0"), "id"), "odd": (rows.where("id % 2 = 1"), "id")}


def ids(spark, root, name):
    return sorted(r["id"] for r in targets.read(spark, root, name, ID_ONLY).collect())


def test_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    assert ids(spark, root, "even") == []
    assert targets.commit_together(spark, root, batch(spark, 0, 10)) == 1
    failing = spark.range(10, 20).withColumn("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        targets.commit_together(spark, root, {"even": (spark.range(10, 20, 2), "id"), "odd": (failing, "id")})
    assert len(list((tmp_path / "out" / "even").glob("commit=*"))) == 2  # written, but not seen
    assert ids(spark, root, "even") == [0, 2, 4, 6, 8] and ids(spark, root, "odd") == [1, 3, 5, 7, 9]
    assert targets.commit_together(spark, root, batch(spark, 5, 20)) == 2
    assert ids(spark, root, "even") == list(range(0, 20, 2)) and ids(spark, root, "odd") == list(range(1, 20, 2))
    assert targets.commit_together(spark, root, batch(spark, 5, 20)) == 3
    assert ids(spark, root, "even") == list(range(0, 20, 2))


def test_the_later_of_two_writers_compares_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    publish, calls = targets._publish, []

    def late(spark, root, number, mark):
        calls.append(number)
        if len(calls) == 1:  # somebody else finishes the same keys in between
            monkeypatch.setattr(targets, "_publish", publish)
            assert targets.commit_together(spark, root, batch(spark, 0, 6)) == number
        return publish(spark, root, number, mark)

    monkeypatch.setattr(targets, "_publish", late)
    assert targets.commit_together(spark, root, batch(spark, 0, 10)) == 2
    assert ids(spark, root, "even") == [0, 2, 4, 6, 8] and ids(spark, root, "odd") == [1, 3, 5, 7, 9]


def test_nulls_repeats_and_names(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x"), (None, "x")], "id long, v string")
    targets.commit_together(spark, root, {"t": (rows, "id")})
    assert sorted(targets.read(spark, root, "t").collect(), key=str) == sorted(
        [(1, "a"), (None, "x"), (None, "x")], key=str)
    targets.commit_together(spark, root, {"t": (rows.where("false"), "id")})
    assert targets.read(spark, root, "t").count() == 3
    with pytest.raises(ValueError):
        targets.commit_together(spark, root, {"commits": (rows, "id")})
    with pytest.raises(ValueError):
        targets.commit_together(spark, root, {"u": (rows.withColumn("commit", F.lit(1)), "id")})
