"""Stages on small fixtures: what goes, what stays, and odd tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from test_nearcopies import least_of_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder_of(tmp, docs, labels):
    docs.write.mode("overwrite").parquet(os.path.join(tmp, "documents.parquet"))
    labels.write.mode("overwrite").parquet(os.path.join(tmp, "labels.parquet"))
    return str(tmp)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_tables(spark, tmp_path, kind, request):
    docs = request.getfixturevalue(kind)
    labels = spark.createDataFrame([(1, 0, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    folder = folder_of(tmp_path, docs.drop("score", "features"), labels)
    docs = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        found.count()
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns[:2] == ["doc_id", "start"]
    assert (packed.count() == 0) == (kind == "empty")


def test_stages_on_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    toxic = [i for i, t in labels.items() if t == 1]
    assert sum(i in ids for i in clean) >= 0.95 * len(clean)
    assert sum(i in ids for i in toxic) <= 0.3 * len(toxic)  # a few dozen to learn from
    known = corpus_pipeline.drop_unknown_languages(spark, docs, folder)
    assert known.columns == COLUMNS and known.count() >= 998
    wanted, _ = least_of_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    left = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    assert Counter(left) == Counter(wanted)
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, folder).collect())
    assert set(mixed) == {r["doc_id"] for r in docs.select("doc_id").collect()}
