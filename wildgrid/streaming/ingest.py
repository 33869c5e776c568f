"""Incremental runs over landed files: cleaning, enrichment, scoring.

Every batch reads what is already in the targets and adds only new ids, so a
repeated batch, or a lost checkpoint, changes nothing. The two outputs of a
cleaning or enrichment batch appear together; read them with ``targets.read``.
"""

from pyspark.sql import functions as F, types as T

from ..operators import enrich
from ..operators.clean import dedupe_first, least_rows
from ..plans.cleaning import clean_batch
from ..operators.storage import settle, steps_removed
from ..schemas import (
    CASCADE_RESULTS, ID_ONLY, RAW_OBSERVATIONS, WEATHER_JOB, weather_payload, weather_snapshot)
from ..sources import targets
from ..sources.sinks import append_new, read_or_empty


def _run(stream, work, checkpoint, available_now=True):
    def tidy(batch, number):
        # The session is the stream's own: its batches leave neither shuffles nor steps behind.
        batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        with steps_removed(batch.sparkSession):
            work(batch, number)

    writer = stream.writeStream.foreachBatch(tidy).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_cleaning(spark, source, out, checkpoint, cells=None, files_per_batch=100,
                    schema=RAW_OBSERVATIONS, fmt="csv", available_now=True, multi_line=True):
    """Clean unseen files; append to ``out/interim`` and ``out/bad_quality``.

    ``multi_line=False`` splits large files, for text without quoted line breaks.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    rows = reader.format(fmt).load(source).withColumn("input_order", F.struct(
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block")))

    def work(batch, number):
        session = batch.sparkSession
        numbered = batch.withColumn("input_order", F.struct(
            F.col("input_order.at").alias("at"), F.col("input_order.file").alias("file"),
            F.col("input_order.block").alias("block"), F.monotonically_increasing_id().alias("row")))
        done = [targets.read(session, out, t, ID_ONLY) for t in ("interim", "bad_quality")]
        good, bad = clean_batch(numbered, cells, done)
        targets.commit_together(session, out, {"bad_quality": (bad, "id"), "interim": (good, "id")})

    return _run(rows, work, checkpoint, available_now)


def stream_enrichment(spark, source, out, checkpoint, files_per_batch=100, available_now=True):
    """Landed lines {job fields, payload} -> ``out/snapshots`` and ``out/rejects``.

    Every line ends in one of them: rejects (id, reason, line) also hold lines
    that are no JSON and those without an id, with their text. Of several lines
    of a job the first good one counts, whenever it comes; see ``open_rejects``.
    """
    broken = "_line"
    schema = T.StructType([*WEATHER_JOB.fields, T.StructField("payload", weather_payload()),
                           T.StructField(broken, T.StringType())])
    lines = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
             .option("columnNameOfCorruptRecord", broken).json(source))
    jobs = [f.name for f in schema.fields if f.name != broken]

    def work(batch, number):
        session = batch.sparkSession
        lost = F.when(F.col(broken).isNotNull(), "unreadable").when(F.col("id").isNull(), "no id")
        line = F.when(lost.isNotNull(), F.coalesce(broken, F.to_json(F.struct(*jobs))))
        # Lines are read once; their payloads, many times larger than a snapshot, are not written again.
        landed = settle(enrich.judged(batch, also=[lost.alias("_lost"), line.alias("line")]), "landed")
        known = landed.where("_lost is null")
        done = targets.read(session, out, "snapshots", weather_snapshot()).select("id")
        seen = settle(done.join(known.select("id").distinct(), "id", "left_semi").distinct(), "seen")
        fresh = known.join(seen, "id", "left_anti")
        # Copies of a job: the first reading in time, then by content, is kept.
        kept = fresh.where("reason is null").select(*weather_snapshot().names)
        kept = kept.withColumn("_h", F.xxhash64(*kept.columns))
        kept = settle(dedupe_first(kept, "id", ["observed_on", "_h"]).drop("_h"), "kept")
        rejected = fresh.where("reason is not null").join(kept.select("id"), "id", "left_anti").select("id", "reason", "line")
        unread = landed.where("_lost is not null").select(
            F.when(F.col("_lost") == "no id", F.col("id")).alias("id"), F.col("_lost").alias("reason"), "line")
        rejects = rejected.unionByName(unread).withColumn("key", F.md5(F.concat_ws(
            "|", F.col("id").cast("string"), "reason", "line")))
        targets.commit_together(session, out, {"rejects": (rejects, "key"), "snapshots": (kept, "id")})

    return _run(lines, work, checkpoint, available_now)


def open_rejects(spark, out):
    """(id, reason, line) of lines whose job has not been delivered well since."""
    rejects = targets.read(spark, out, "rejects").drop("key")
    done = targets.read(spark, out, "snapshots", weather_snapshot()).select("id")
    return rejects.join(done, "id", "left_anti").select("id", "reason", "line")


def stream_scoring(spark, source, schema, out, checkpoint, score, files_per_batch=100,
                   available_now=True):
    """Score unseen observations; ``score`` maps a batch to cascade results.

    The least row of an id is scored. Scored ids are kept beside the results, in
    ``<out>_ids``, so that an id without a result is not scored again.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    ids = f"{out.rstrip('/')}_ids"

    def work(batch, number):
        session = batch.sparkSession
        own = settle(batch.select("id").distinct(), "batch-ids")
        done = read_or_empty(session, out, CASCADE_RESULTS).select("id").unionByName(
            read_or_empty(session, ids, ID_ONLY).select(F.col("id").cast("long").alias("id")))
        seen = settle(done.join(own, "id", "left_semi").distinct(), "seen")
        fresh = settle(least_rows(batch.join(seen, "id", "left_anti"), "id"), "fresh")
        results = score(fresh)
        results.write.mode("append").parquet(out)
        append_new(fresh.select("id"), ids, "id")

    return _run(rows, work, checkpoint, available_now)
