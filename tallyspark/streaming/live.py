"""Structured Streaming paths.

The built-in file stream delivers each *file* once and never re-reads a path
it has seen; it serves immutable landing files (one file per flush or rotation).
Append-style logs have a source of their own, which delivers appended lines.

* ``stream_ingest`` -- landing JSONL -> fact table.  Each micro-batch runs
  the batch pipeline (line numbers, decode, first-wins) and an
  insert-or-ignore against the stored ids inside ``foreachBatch``, so a
  replayed batch after a failure adds nothing (exactly-once effect on the
  table, at-least-once delivery).
* ``tail_ingest`` -- the same for logs that grow: the stream's offset is what was
  consumed of each file, in whole lines, so each run reads the bytes that were appended.
* Live totals come with both: each load and each delete commits signed deltas once
  (``plans.totals``), so rows of any age count, however late, deletes are
  taken away, and a replayed batch changes nothing.  ``plans.ingest.live_totals`` reads them.
* ``live_bucket_totals`` -- rolling sums from the stream alone, with an
  event-time watermark and de-duplication of message ids within it, for a
  display that needs no stored table.  It leaves out rows later than the watermark.

Triggers: ``available_now=True`` processes everything present and stops (an
initial full load, a forced refresh); otherwise ``processingTime`` runs a
periodic reconcile (60 s by default).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import bucket_key, rfc3339_to_utc, zero_time
from ..plans.ingest import UsageStore, load_lines, manifest_log, recover
from ..schemas import ASSISTANT_TYPE, LOG_LINE_WITH_CORRUPT, TOKEN_COLUMNS
from ..sources.logs import LINE_SEPARATOR, LOG_GLOB, with_file_columns
from ..sources.ranges import LogTail
from ..sources.tables import staged, staging

RECONCILE_INTERVAL = "60 seconds"


def landing_stream(spark: SparkSession, landing: str, glob: str = LOG_GLOB,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming lines of new landing files, with the scan's file metadata."""
    reader = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", LINE_SEPARATOR)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_file_columns(reader.load(landing))


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _started(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    w = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def stream_ingest(spark: SparkSession, landing: str, store: UsageStore, checkpoint: str,
                  glob: str = LOG_GLOB, available_now: bool = True, interval: str = RECONCILE_INTERVAL) -> StreamingQuery:
    """Start the landing -> fact table stream (insert-or-ignore per batch).

    A replayed batch adds no row and hides its earlier quarantine rows.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        load_lines(spark, batch.withColumn("row_id", F.monotonically_increasing_id()), landing, store, _now())

    return _started(landing_stream(spark, landing, glob), write, checkpoint, available_now, interval)


def resolved(spark: SparkSession, store: UsageStore, lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Tailed lines with the line number each range resumes at, and what is known of the files it resumes in.

    Both come from the manifest row whose run ended at the range's offset, so a replayed
    batch finds what it found the first time.
    """
    log = manifest_log(spark, store)
    if log is None:
        return lines.withColumn("base_line", F.lit(0).cast("bigint")), None
    files = lines.where("base_offset > 0").select("source_file", "base_offset").distinct()
    at = log.withColumnRenamed("resume_offset", "base_offset").join(files, ["source_file", "base_offset"], "left_semi")
    row = F.struct("resume_line", "generation", "head_bytes", "head_crc")
    at = staged(at.groupBy("source_file", "base_offset").agg(F.max_by(row, F.struct("updated_at", "run_id")).alias("r")), "tail-resumed")
    lost = F.raise_error(F.concat(F.lit("the store has no run that ends where the checkpoint resumes: "), F.col("source_file")))
    base = F.when(F.col("base_offset") == 0, 0).otherwise(F.coalesce("r.resume_line", lost.cast("bigint")))
    out = lines.drop("base_line").join(at, ["source_file", "base_offset"], "left").withColumn("base_line", base).drop("r")
    return out, at.select("source_file", "r.generation", "r.head_bytes", "r.head_crc")


def tail_ingest(spark: SparkSession, root: str, store: UsageStore, checkpoint: str,
                glob: str = LOG_GLOB, available_now: bool = True, interval: str = RECONCILE_INTERVAL) -> StreamingQuery:
    """Start the stream of lines appended below ``root`` into the fact table."""
    spark.dataSource.register(LogTail)

    def write(batch: DataFrame, epoch_id: int) -> None:
        with staging(spark):
            recover(spark, store)
            lines, known = resolved(spark, store, staged(batch, "tail-lines"))
            load_lines(spark, lines, root, store, _now(), known)

    lines = spark.readStream.format(LogTail.name()).option("glob", glob).load(root)
    return _started(lines, write, checkpoint, available_now, interval)


def parsed_usage_stream(lines: DataFrame) -> DataFrame:
    """Streaming decode: usage rows without line numbers (not needed live)."""
    j = F.from_json("value", LOG_LINE_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    p = lines.filter(F.length("value") > 0).withColumn("j", j)
    ok = (
        p.filter(F.col("j._corrupt").isNull())
        .filter(F.col("j.type") == F.lit(ASSISTANT_TYPE))
        .filter(F.col("j.message.usage").isNotNull() & (F.coalesce(F.col("j.message.id"), F.lit("")) != ""))
    )
    ts = F.when(F.col("j.timestamp").isNull(), zero_time()).otherwise(rfc3339_to_utc(F.col("j.timestamp")))
    u = F.col("j.message.usage")
    return ok.select(
        F.col("j.message.id").alias("message_id"),
        F.coalesce(F.col("j.message.model"), F.lit("")).alias("model"),
        ts.alias("ts"),
        F.coalesce(u.input_tokens, F.lit(0)).alias("input_tokens"),
        F.coalesce(u.output_tokens, F.lit(0)).alias("output_tokens"),
        F.coalesce(u.cache_creation_input_tokens, F.lit(0)).alias("cache_creation_tokens"),
        F.coalesce(u.cache_read_input_tokens, F.lit(0)).alias("cache_read_tokens"),
    ).filter(F.col("ts").isNotNull())


def live_bucket_totals(usage_stream: DataFrame, bucket: str = "hour", watermark: str = "2 hours") -> DataFrame:
    """Per (bucket window, model) token sums; ids de-duplicated within the watermark."""
    size = "1 hour" if bucket == "hour" else "1 day"
    ts = F.col("ts").cast("timestamp")
    s = usage_stream.withColumn("event_time", ts).withWatermark("event_time", watermark)
    s = s.dropDuplicatesWithinWatermark(["message_id"])
    agg = s.groupBy(F.window("event_time", size).alias("w"), "model").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.count(F.lit(1)).alias("messages")
    )
    return agg.select(
        bucket_key(F.col("w.start").cast("timestamp_ntz"), bucket).alias("bucket"), "model", *TOKEN_COLUMNS, "messages"
    )


def checkpoint_path(store: UsageStore, name: str) -> str:
    return os.path.join(store.base, "_streams", name)
