import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.llm.neighbours import nearest


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_recall_on_tables(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows.collect()}
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = {}
    for r in nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]])), abs=1e-12)
    hits = sum(len(set(want[q]) & set(found[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_with_different_norms(spark):
    drawn = np.random.default_rng(1)
    vectors = {i: drawn.normal(size=16) * drawn.uniform(0.2, 3) for i in range(600)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    want = exact(vectors, range(0, 600, 20), 10)
    found = {}
    for r in nearest(rows, F.col("vec_id") % 20 == 0, k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(set(want[q]) & found[q]) for q in want) >= 0.9 * 300


def test_few_odd_and_tied_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-5.0, 0.1]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    found = nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 3), (20, 1, 3), (20, 2, 0), (20, 3, 1), (20, 4, 2)]
    assert nearest(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_session_setting_comes_back(spark, small):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "777")
    nearest(spark.read.parquet(f"{small}/embeddings.parquet"), F.col("vec_id") % 20 == 0).count()
    assert spark.conf.get(setting) == "777"
    spark.conf.unset(setting)
