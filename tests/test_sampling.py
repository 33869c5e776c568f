"""Exact sizes and repeatability, also when one class holds most rows."""

import hashlib

from pyspark.sql import functions as F

from wildgrid.operators import ranks, sampling
from wildgrid.operators.profile import impute_group_mean, large_classes
from wildgrid.operators.quantiles import exact_quantiles


def skewed(spark, n=20000):
    """Two thirds of the rows in one class, then a long tail of small ones."""
    label = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("c"), F.floor(F.sqrt("id"))))
    return spark.range(n).select("id", label.alias("label"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))


def key(i, seed):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_split_is_exact_and_a_partition(spark):
    df = skewed(spark)
    split = sampling.stratified_split(df, "label", seed=3)
    rows = split.collect()
    assert len(rows) == 20000 and len({r["id"] for r in rows}) == 20000
    classes = {}
    for r in rows:
        classes.setdefault(r["label"], []).append(r)
    for members in classes.values():
        order = sorted(members, key=lambda r: key(r["id"], 3))
        k = round(0.2 * len(members))
        assert {r["id"] for r in members if r["is_holdout"]} == {r["id"] for r in order[:k]}
    again = sampling.stratified_split(df.repartition(13), "label", seed=3).where("is_holdout")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in rows if r["is_holdout"]}


def test_tiny_classes_have_no_holdout(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, label string")
    assert sampling.stratified_split(df, "label").where("is_holdout").count() == 0


def test_folds_differ_by_one_row(spark):
    counts = sampling.stratified_folds(skewed(spark), "label").groupBy("label", "fold").count().collect()
    sizes = {}
    for r in counts:
        sizes.setdefault(r["label"], {})[r["fold"]] = r["count"]
    for per_fold in sizes.values():
        filled = [per_fold.get(f, 0) for f in range(5)]
        assert max(filled) - min(filled) <= 1
    blocks = sampling.ordered_folds(skewed(spark, 1003), ["id"]).groupBy("fold").agg(
        F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("fold").collect()
    assert [r["n"] for r in blocks] == [201, 201, 201, 200, 200]
    assert all(a["hi"] < b["lo"] for a, b in zip(blocks, blocks[1:]))


def test_rank_of_a_hot_group(spark):
    ranked = ranks.exact_rank(skewed(spark), [F.desc("x"), "id"], "label")
    rows = ranked.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["label"], []).append(r)
    for members in groups.values():
        order = sorted(members, key=lambda r: (-r["x"], r["id"]))
        assert [r["rank"] for r in order] == list(range(1, len(members) + 1))


def test_rank_with_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    assert sorted((r["id"], r["rank"]) for r in ranks.exact_rank(df, ["id"], "g").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_random_sample(spark):
    df = spark.range(1000)
    got = {r["id"] for r in sampling.random_sample(df, fraction=0.05, seed=9).collect()}
    assert got == set(sorted(range(1000), key=lambda i: key(i, 9))[:50])


def test_oversampling(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else "mid" if i < 70 else "few") for i in range(75)],
                               "id long, label string")
    more = sampling.oversample_smallest(df, "label")
    counts = {r["label"]: r["count"] for r in more.groupBy("label").count().collect()}
    assert counts == {"big": 50, "mid": 20, "few": 50}
    assert more.where("copy > 0").select("id").distinct().count() <= 5
    even = df.where("label = 'mid'")
    assert sampling.oversample_smallest(even, "label").count() == 20


def test_quantiles_of_a_hot_value(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 != 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = sorted(r["v"] for r in df.collect())

    def expected(p):
        pos = (len(values) - 1) * p
        lo = int(pos)
        hi = min(lo + 1, len(values) - 1)
        return values[lo] + (values[hi] - values[lo]) * (pos - lo)

    for r in exact_quantiles(df, ["v"], [0, 0.025, 0.3, 0.5, 0.9, 1]).collect():
        assert abs(r["value"] - expected(r["p"])) < 1e-9


def test_group_value_of_a_hot_group(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x")))
    filled = impute_group_mean(df, "x", "label")
    assert filled.count() == 20000
    mean = df.where("label = 'hot'").agg(F.avg("x")).first()[0]
    got = filled.join(df.where("x is null and label = 'hot'").select("id"), "id").agg(F.min("x"), F.max("x")).first()
    assert abs(got[0] - mean) < 1e-9 and abs(got[1] - mean) < 1e-9
    assert large_classes(df, "label", 3000, "id").select("label").distinct().count() == 1
