"""Incremental runs: new files only, overlapping ids, lost checkpoints."""

import os

from pyspark.sql import functions as F

from wildgrid.operators import enrich
from wildgrid.operators.storage import settle
from wildgrid.plans import adapter, catalogue
from wildgrid.plans.adapter import land_weather_jobs, raw_observations, weather_jobs
from wildgrid.sources import targets
from wildgrid.sources.sinks import overwrite
from wildgrid.streaming import ingest
from wildgrid.streaming.ingest import open_rejects, stream_cleaning, stream_enrichment, stream_scoring


def counts(spark, out):
    return tuple(targets.read(spark, out, t).select("id").distinct().count()
                 for t in ("interim", "bad_quality"))


def test_cleaning_twice_and_with_a_lost_checkpoint(spark, small, tmp_path):
    raw = raw_observations(spark, small).drop("input_order").cache()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    overwrite(raw.where("id < 600").coalesce(1), f"{source}/one", "csv")
    run = lambda name: stream_cleaning(spark, f"{source}/*", out, str(tmp_path / name)).awaitTermination()
    run("checkpoint")
    first = counts(spark, out)
    overwrite(raw.where("id >= 400").coalesce(1), f"{source}/two", "csv")
    run("checkpoint")
    second = counts(spark, out)
    run("checkpoint")
    run("other-checkpoint")
    assert counts(spark, out) == second and sum(second) > sum(first) > 0
    for t in ("interim", "bad_quality"):
        df = targets.read(spark, out, t)
        assert df.count() == df.select("id").distinct().count()


def test_enrichment_keeps_and_rejects(spark, small, tmp_path):
    jobs = weather_jobs(spark, small)
    jobs.write.json(str(tmp_path / "in"))
    for name in ("c1", "c2"):
        stream_enrichment(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / name)).awaitTermination()
    kept = targets.read(spark, str(tmp_path / "out"), "snapshots")
    rejected = targets.read(spark, str(tmp_path / "out"), "rejects")
    assert kept.count() + rejected.count() == jobs.count()
    assert len(kept.columns) == 52
    assert {r["reason"] for r in rejected.select("reason").distinct().collect()} == {"no such hour", "missing reading"}


def test_every_line_is_accounted_for(spark, small, tmp_path):
    """Broken lines and lines without an id are kept; a late good payload closes its reject."""
    jobs = weather_jobs(spark, small)
    good = jobs.join(enrich.snapshots(jobs)[0].select("id"), "id", "left_semi").limit(2).select(jobs.columns).cache()
    first, second = [r["id"] for r in good.collect()]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    poor = good.where(f"id = {first}").withColumn("payload", F.lit(None).cast(good.schema["payload"].dataType))
    poor.unionByName(good.where(f"id = {second}")).unionByName(good.where(f"id = {second}")) \
        .unionByName(good.limit(1).withColumn("id", F.lit(None).cast("long"))).write.json(source + "/one")
    (tmp_path / "in" / "one" / "broken.json").write_text('{"id": 5, "payload": {oops\n')
    run = lambda name: stream_enrichment(spark, source + "/*", out, str(tmp_path / name)).awaitTermination()
    run("c")
    reasons = sorted(r["reason"] for r in open_rejects(spark, out).collect())
    assert reasons == ["no id", "no payload", "unreadable"]
    assert "oops" in open_rejects(spark, out).where("reason = 'unreadable'").first()["line"]
    good.where(f"id = {first}").write.json(source + "/two")
    run("c")
    run("other")
    assert sorted(r["id"] for r in targets.read(spark, out, "snapshots").collect()) == sorted([first, second])
    assert sorted(r["reason"] for r in open_rejects(spark, out).collect()) == ["no id", "unreadable"]


def test_repeated_ids_and_ids_without_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "none")], "id long, label string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []

    def score(batch):
        seen.append(sorted(r["id"] for r in batch.collect()))
        return batch.where("label = 'a'").select(
            "id", F.lit("family").alias("taxonomic_level"), F.lit("a").alias("joint_prediction"),
            F.lit("a").alias("image_prediction"), F.lit("a").alias("meta_prediction"), F.col("label").alias("true_label"))

    for name in ("c1", "c2"):
        stream_scoring(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / name),
                       score).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert seen[0] == [1, 2, 3] and not any(seen[1:])


def test_scoring_resumes(spark, tmp_path):
    rows = spark.range(20).select("id", F.lit("a").alias("label"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []

    def score(batch):
        seen.append(batch.count())
        return batch.select("id", F.lit("family").alias("taxonomic_level"), F.lit("a").alias("joint_prediction"),
                            F.lit("a").alias("image_prediction"), F.lit("a").alias("meta_prediction"),
                            F.col("label").alias("true_label"))

    for name in ("c1", "c1", "c2"):
        stream_scoring(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / name),
                       score).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert seen[0] == 20 and sum(seen[1:]) == 0


def own_tables(spark, folder, n=400):
    """Events, some ids of which come twice and some are null, and customers."""
    i = F.col("id")
    spark.range(n).select(
        F.when(i % 50 != 7, i % (n - 20)).alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 613)").alias("ts"),
        (i * 7 % 40).alias("user_id"), F.lit("view").alias("event_type"), (i % 31 + 0.25).alias("value"),
        F.lit("{}").alias("props")).write.parquet(f"{folder}/events.parquet")
    spark.range(9).select(i.alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_payloads_are_not_written_again(spark, tmp_path, monkeypatch):
    """A batch writes snapshots and verdicts; the payloads stay in the landed lines."""
    weather_jobs(spark, own_tables(spark, str(tmp_path))).write.json(str(tmp_path / "in"))
    written = []
    for module in (ingest, enrich):
        monkeypatch.setattr(module, "settle", lambda df, name="step": written.append(df.columns) or settle(df, name))
    stream_enrichment(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert written and not any("payload" in columns for columns in written)


def test_batches_leave_no_shuffles(spark, tmp_path):
    """Shuffle files of a batch go with it, and the caller's session keeps its setting."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.range(9).write.parquet(str(tmp_path / "in"))
    before, seen = spark.conf.get(setting), []
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    ingest._run(rows, lambda batch, _: seen.append(batch.sparkSession.conf.get(setting)),
                str(tmp_path / "c")).awaitTermination()
    assert seen == ["true"] and spark.conf.get(setting) == before


def test_jobs_land_in_parts(spark, tmp_path, monkeypatch):
    """All jobs, those of an id in one part, one part on the disk at a time."""
    monkeypatch.setattr(adapter, "JOBS_LANDED", 150)
    folder, path = own_tables(spark, str(tmp_path)), str(tmp_path / "landed")
    parts = []
    for _ in land_weather_jobs(spark, folder, path):
        parts.append([(r["id"], r["obs_time"]) for r in spark.read.json(path).collect()])
    assert len(parts) == 3 and not os.path.exists(path)
    whole = [(r["id"], r["obs_time"]) for r in weather_jobs(spark, folder).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(sum(parts, [])) == order(whole)
    ids = [{i for i, _ in part} for part in parts]
    assert sum(map(len, ids)) == len(set.union(*ids))


def test_streams_over_parts_give_the_same_rows(spark, tmp_path, monkeypatch):
    """Each of three parts is read by every stream of a query."""
    folder, (queries, _) = own_tables(spark, str(tmp_path)), catalogue.load()
    runs = []
    monkeypatch.setattr(ingest, "stream_enrichment", lambda *args: runs.append(args[-1]) or stream_enrichment(*args))
    for name, streams in (("enrich_stream", 1), ("stream_accounting", 2)):
        found = []
        for landed, parts in ((10_000, 1), (150, 3)):
            monkeypatch.setattr(adapter, "JOBS_LANDED", landed)
            runs.clear()
            found.append(sorted(map(str, queries[name](spark, folder).collect())))
            assert len(runs) == streams * parts and len(set(runs)) == streams
        assert found[0] and found[0] == found[1]
