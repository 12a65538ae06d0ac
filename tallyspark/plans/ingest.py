"""Incremental ingest of JSONL session logs into a usage fact table.

Store layout (all under one base path on a shared filesystem):

    usage/        Parquet, partitioned by usage_date, sorted by session inside files
    ids/          message ids ever stored or deleted, with their day: bucketed Parquet, in versions
    manifest/     Parquet append log: one row per file per run that read it whole
    quarantine/   Parquet append log of rejected lines, by run
    tombstones/   Parquet append log of deleted message ids
    totals/       signed deltas of the live totals (``plans.totals``)
    _intents/     what a run is about to apply; removed when it is applied

One run:

1. apply what an interrupted run left in ``_intents``;
2. list ``*.jsonl`` under the root with the binaryFile source (path, length,
   modification time; the content column is pruned, never read);
3. keep files whose (length, modification time) differ from the newest
   manifest row for that path.  A file that only grew -- it still begins with the line it
   began with, and a line ends at the saved offset -- is read from that offset
   (``sources.ranges``); new, truncated and rewritten files are read whole, in one scan of the
   root without files older than the oldest of them;
4. decode every line once into a staged table; from it: line numbers, the fact rows (first
   wins), the rejected lines and the files that were read whole;
5. drop message ids that are in ``ids`` (insert-or-ignore), write the new rows as
   an intent, apply it (facts, ids, totals), append the rejected lines, then the manifest rows.

A file that could not be read to its end adds nothing and gets no manifest row,
so the next run tries it again; the others are not held up.  A crash at any point is safe: a
finished intent is applied again, each part of it once; a run that left none is
repeated, as its files have no manifest row.  One writer works on a store at a time.  File names
and rows stay in DataFrames; only counters, and the ids of small batches, reach the driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TOKEN_COLUMNS, USAGE
from ..session import scratch_dir
from ..sources.logs import (
    LOG_GLOB,
    block_totals,
    decoded_lines,
    decoded_path,
    file_totals,
    first_wins,
    number_lines,
    quarantine,
    scan_lines,
    to_usage,
)
from ..sources.ranges import read_ranges, unbroken
from ..sources.tables import committed_versions, delete_path, finished_paths, path_exists, short_splits, staged, staging
from .totals import TotalsLog, deltas

#: Ids of a batch up to which they are looked up by value, so that only their buckets are read.
PROBE_IDS = 1000


@dataclass(frozen=True)
class UsageStore:
    base: str
    id_buckets: int = 64  # of a new store's ``ids``; fixed for its life

    @property
    def usage(self) -> str:
        return os.path.join(self.base, "usage")

    @property
    def ids(self) -> str:
        return os.path.join(self.base, "ids")

    @property
    def manifest(self) -> str:
        return os.path.join(self.base, "manifest")

    @property
    def quarantine(self) -> str:
        return os.path.join(self.base, "quarantine")

    @property
    def tombstones(self) -> str:
        return os.path.join(self.base, "tombstones")

    @property
    def totals(self) -> str:
        return os.path.join(self.base, "totals")

    @property
    def intents(self) -> str:
        return os.path.join(self.base, "_intents")


def list_files(spark: SparkSession, root: str, glob: str = LOG_GLOB) -> DataFrame:
    """(source_file, length, modified_at) of every log file under ``root`` that holds a byte."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return listing.select(
        decoded_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("length"),
        F.col("modificationTime").alias("modified_at"),
    )


MANIFEST = (
    "source_file string, byte_offset bigint, last_line bigint, modified_at timestamp, updated_at timestamp_ntz, run_id string, "
    "resume_offset bigint, resume_line bigint, head_bytes bigint, head_crc bigint, generation string"
)


def manifest_log(spark: SparkSession, store: UsageStore) -> DataFrame | None:
    """All manifest rows.  ``generation`` is the run that last read the file whole."""
    if not path_exists(spark, store.manifest):
        return None
    log = spark.read.schema(MANIFEST).parquet(store.manifest)
    return log.withColumn("generation", F.coalesce("generation", "run_id"))


def current_manifest(spark: SparkSession, store: UsageStore) -> DataFrame | None:
    """Newest manifest row per file (an aggregate over the append log)."""
    log = manifest_log(spark, store)
    if log is None:
        return None
    row = F.struct(*[c for c in log.columns if c != "source_file"])
    newest = log.groupBy("source_file").agg(F.max_by(row, F.struct("updated_at", "run_id")).alias("m"))
    return newest.select("source_file", "m.*")


def changed_files(listing: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files that are new or whose length / modification time changed, with the manifest's resume columns.

    A file shorter than its saved offset (truncated) is one such change.
    """
    resume = ["resume_offset", "resume_line", "head_bytes", "head_crc", "generation"]
    if manifest is None:
        kinds = dict(zip(resume, ["bigint"] * 4 + ["string"], strict=True))
        return listing.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()} | {"grown": F.lit(False)})
    same = (
        (F.col("l.length") == F.col("m.byte_offset")) & (F.col("l.modified_at") == F.col("m.modified_at"))
    )
    joined = listing.alias("l").join(manifest.alias("m"), F.col("l.source_file") == F.col("m.source_file"), "left")
    grown = F.coalesce((F.col("l.length") > F.col("m.byte_offset")) & F.col("m.head_crc").isNotNull(), F.lit(False))
    return joined.filter(F.col("m.source_file").isNull() | ~same).select(
        "l.*", *[F.col(f"m.{c}") for c in resume], grown.alias("grown")
    )


# --- stored ids -----------------------------------------------------------------


def _ids_table(spark: SparkSession, store: UsageStore, version: int) -> str:
    """Catalog entry of a version of the ids: Parquet in ``id_buckets`` buckets by message id."""
    path = f"{store.ids}/v={version}"
    name = "tally_ids_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (message_id STRING, usage_date DATE) USING parquet "
        f"CLUSTERED BY (message_id) INTO {store.id_buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def _put_ids(spark: SparkSession, store: UsageStore, ids: DataFrame, version: int) -> None:
    name = _ids_table(spark, store, version)
    # One file a bucket.
    ids.select("message_id", "usage_date").repartition(store.id_buckets, "message_id").write.insertInto(name)
    spark.catalog.refreshTable(name)


def stored_ids(spark: SparkSession, store: UsageStore) -> DataFrame | None:
    """(message_id, usage_date) of all ids stored or deleted (deleted ones may have no day); rows may repeat.

    A store without ``ids`` gets them from its facts and tombstones.
    """
    versions = committed_versions(spark, store.ids)
    if not versions:
        parts = []
        if path_exists(spark, store.usage):
            parts.append(spark.read.schema(USAGE).parquet(store.usage).select("message_id", "usage_date"))
        if path_exists(spark, store.tombstones):
            dead = spark.read.parquet(store.tombstones)
            parts.append(dead.select("message_id", F.lit(None).cast("date").alias("usage_date")))
        if not parts:
            return None
        _put_ids(spark, store, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), 1)
        versions = [1]
    return spark.table(_ids_table(spark, store, versions[-1]))


def append_ids(spark: SparkSession, store: UsageStore, ids: DataFrame) -> None:
    """Add ids whose facts or tombstones are stored."""
    versions = committed_versions(spark, store.ids)
    if versions:
        _put_ids(spark, store, ids, versions[-1])
    else:  # they are among what the first version is made of
        stored_ids(spark, store)


def compact_ids(spark: SparkSession, store: UsageStore) -> None:
    """One file a bucket again, in a new version; the version before stays for readers, older ones go."""
    ids = stored_ids(spark, store)
    if ids is not None:
        old = committed_versions(spark, store.ids)
        _put_ids(spark, store, ids.groupBy("message_id").agg(F.max("usage_date").alias("usage_date")), old[-1] + 1)
        for n in old[:-1]:
            spark.sql(f"DROP TABLE IF EXISTS {_ids_table(spark, store, n)}")
            delete_path(spark, f"{store.ids}/v={n}")


def among_stored(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored ids that ``rows`` (a staged table) has.

    A small batch's ids become values of a filter, which leaves the files of their buckets
    and, by the statistics of the files, little of those.  A larger batch is shuffled to the
    buckets and joined there; the stored ids are not moved.
    """
    few = [r.message_id for r in rows.select("message_id").distinct().limit(PROBE_IDS + 1).collect()]
    if len(few) <= PROBE_IDS:
        return ids.where(F.col("message_id").isin(few))
    return ids.join(rows.select("message_id"), "message_id", "left_semi")


def drop_known(spark: SparkSession, store: UsageStore, rows: DataFrame) -> DataFrame:
    """Insert-or-ignore: the rows whose message id was never stored."""
    ids = stored_ids(spark, store)
    if ids is None:
        return rows
    rows = staged(rows, "ingest-batch")
    return rows.join(among_stored(ids, rows), "message_id", "left_anti")


# --- intents ----------------------------------------------------------------------


def _apply_insert(spark: SparkSession, store: UsageStore, path: str, again: bool) -> None:
    """Store the rows of an insert intent: facts, ids and deltas, each once."""
    rows = spark.read.schema(USAGE).parquet(path)
    fresh = rows
    if again and path_exists(spark, store.usage):  # some may be stored already
        there = spark.read.schema(USAGE).parquet(store.usage).join(_days(rows), "usage_date", "left_semi")
        fresh = staged(rows.join(there.select("message_id"), "message_id", "left_anti"), "ingest-again")
    append_usage(fresh, store)
    append_ids(spark, store, rows)
    TotalsLog(spark, store.totals).commit(path.rsplit("/", 1)[1], deltas(rows, 1))
    delete_path(spark, path)


def _days(rows: DataFrame) -> DataFrame:
    """Calendar days of rows."""
    return rows.select("usage_date").distinct()


def _apply_delete(spark: SparkSession, store: UsageStore, path: str) -> None:
    """Apply a delete intent: tombstones, ids and negative deltas; repeated tombstones and ids change nothing."""
    rows = spark.read.parquet(path)
    rows.select("message_id", "deleted_at").write.mode("append").parquet(store.tombstones)
    append_ids(spark, store, rows.where("usage_date is null"))
    TotalsLog(spark, store.totals).commit(path.rsplit("/", 1)[1], deltas(rows.where("usage_date is not null"), -1))
    delete_path(spark, path)


def recover(spark: SparkSession, store: UsageStore) -> int:
    """Apply the finished intents that an interrupted run left; unfinished ones changed nothing and are dropped."""
    if not path_exists(spark, store.intents):
        return 0
    left = finished_paths(spark, store.intents)
    for path in left:
        kind = path.rsplit("/", 1)[1].split("-")[0]
        if kind == "delete":
            _apply_delete(spark, store, path)
        elif kind == "compact":
            _apply_compact(spark, store, path)
        else:
            _apply_insert(spark, store, path, again=True)
    delete_path(spark, store.intents)
    return len(left)


def append_usage(rows: DataFrame, store: UsageStore) -> None:
    """Append fact rows: few files a day whatever the number of tasks, sorted by session for pruning.

    The rebalance splits a day that is larger than a file should be.
    """
    days = rows.hint("rebalance", "usage_date").sortWithinPartitions("usage_date", "session_id", "ts")
    days.write.mode("append").partitionBy("usage_date").parquet(store.usage)


@dataclass(frozen=True)
class IngestResult:
    files_read: int
    rows_added: int
    rows_quarantined: int
    files_incomplete: int = 0  # not read to their end: nothing loaded, tried again by the next run
    bytes_read: int = 0  # of files read whole and of the ranges of grown ones


def load_lines(spark: SparkSession, lines: DataFrame, root: str, store: UsageStore, now: dt.datetime,
               generations: DataFrame | None = None) -> IngestResult:
    """Load scanned lines: decode once, then fact rows, quarantine and manifest from the staged result.

    ``generations`` has (source_file, generation, head_bytes, head_crc) of files read from an offset.
    """
    run_id = uuid.uuid4().hex
    with staging(spark), short_splits(lines.sparkSession):
        decoded = staged(decoded_lines(lines), "ingest-lines")
        blocks = staged(block_totals(decoded), "ingest-blocks")
        files = file_totals(blocks).withColumns({"updated_at": F.lit(now), "run_id": F.lit(run_id)})
        resumed = F.col("base_offset") > 0
        if generations is None:
            files = files.withColumn("generation", F.col("run_id"))
        else:
            old = ["generation", "head_bytes", "head_crc"]
            old_rows = generations.select("source_file", *[F.col(c).alias(f"_{c}") for c in old])
            files = files.withColumn("generation", F.col("run_id")).join(old_rows, "source_file", "left")
            files = files.withColumns({c: F.when(resumed, F.col(f"_{c}")).otherwise(F.col(c)) for c in old})
        files = staged(files, "ingest-files")
        whole = files.where("whole").select("source_file", "last_line", "open_tail", "generation")
        numbered = number_lines(decoded.where("reject_reason is null or reject_reason <> 'not_usage'"), blocks)
        numbered = staged(numbered.join(whole, "source_file"), "ingest-numbered")

        recover(spark, store)
        rows = drop_known(spark, store, first_wins(to_usage(numbered, root)))
        intent = f"{store.intents}/insert-{run_id}"
        rows.select(*[f.name for f in USAGE.fields]).write.parquet(intent)
        added = spark.read.schema(USAGE).parquet(intent).count()
        if added:
            _apply_insert(spark, store, intent, again=False)
        else:
            delete_path(spark, intent)
        open_tail = (F.col("source_line") == F.col("last_line")) & F.col("open_tail")
        bad = quarantine(numbered, open_tail.alias("open_tail"), "generation")
        bad.withColumns({"run_at": F.lit(now), "run_id": F.lit(run_id)}).write.mode("append").parquet(store.quarantine)
        files.where("whole").selectExpr(*[c.split(" ")[0] for c in MANIFEST.split(", ")]).write.mode("append").parquet(store.manifest)
        n, incomplete, size = files.agg(
            F.count_if("whole"), F.count_if(~F.col("whole")), F.coalesce(F.sum(F.col("byte_offset") - F.col("base_offset")), F.lit(0))
        ).first()
        return IngestResult(n, added, bad.count(), incomplete, size)


def ingest(spark: SparkSession, root: str, store: UsageStore, glob: str = LOG_GLOB,
           now: dt.datetime | None = None) -> IngestResult:
    """One incremental run; returns counters."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    with staging(spark):
        recover(spark, store)
        listing = list_files(spark, root, glob)
        manifest = current_manifest(spark, store)
        changed = staged(changed_files(listing, manifest), "ingest-changed")
        n, n_grown = changed.agg(F.count(F.lit(1)), F.count_if("grown")).first()
        if not n:
            return IngestResult(0, 0, 0)
        if not n_grown:
            return load_lines(spark, _whole_files(spark, root, glob, changed, manifest is not None), root, store, now)
        grown = staged(unbroken(changed.where("grown")), "ingest-grown")
        lines = read_ranges(grown)
        rest = staged(changed.join(grown.select("source_file"), "source_file", "left_anti"), "ingest-whole")
        if rest.head(1):
            whole = _whole_files(spark, root, glob, rest, True)
            whole = whole.withColumn("n_bytes", F.octet_length("value").cast("bigint"))
            lines = lines.unionByName(whole.withColumns({"base_offset": F.lit(0).cast("bigint"), "base_line": F.lit(0).cast("bigint")}))
        return load_lines(spark, lines, root, store, now, grown)


def _whole_files(spark: SparkSession, root: str, glob: str, files: DataFrame, some: bool) -> DataFrame:
    """All lines of the given files; of all files below the root unless ``some``."""
    oldest = files.agg(F.min("modified_at")).first()[0]
    lines = scan_lines(spark, root, glob, since=oldest if some else None)
    return lines.join(files.select("source_file"), "source_file", "left_semi") if some else lines


def read_quarantine(spark: SparkSession, store: UsageStore) -> DataFrame:
    """Rejected lines as the files are now, one row a line.

    Rows of runs that have a manifest row count; of those, the ones since the file was last
    read whole, and lines that were still being written only if no run came after.
    """
    log, newest = manifest_log(spark, store), current_manifest(spark, store)
    if newest is None or not path_exists(spark, store.quarantine):
        return spark.createDataFrame([], "source_file string, source_line bigint, reason string, line string, run_at timestamp_ntz")
    schema = "source_file string, source_line bigint, reason string, line string, open_tail boolean, generation string, run_at timestamp_ntz, run_id string"
    bad = spark.read.schema(schema).parquet(store.quarantine).withColumn("generation", F.coalesce("generation", "run_id"))
    bad = bad.join(log.select("source_file", "run_id"), ["source_file", "run_id"], "left_semi")
    now = newest.select("source_file", "generation", F.col("run_id").alias("last_run"))
    bad = bad.join(now, ["source_file", "generation"]).where(~F.coalesce("open_tail", F.lit(False)) | (F.col("run_id") == F.col("last_run")))
    kept = bad.groupBy("source_file", "source_line").agg(F.max_by(F.struct("reason", "line", "run_at"), F.struct("run_at", "run_id")).alias("r"))
    return kept.select("source_file", "source_line", "r.*")


def read_usage(spark: SparkSession, store: UsageStore) -> DataFrame:
    """The live fact table: stored rows minus tombstoned message ids."""
    u = spark.read.schema(USAGE).parquet(store.usage) if path_exists(spark, store.usage) else spark.createDataFrame([], USAGE)
    if path_exists(spark, store.tombstones):
        u = u.join(spark.read.parquet(store.tombstones).select("message_id"), "message_id", "left_anti")
    return u


# --- deletes (tombstones) and compaction -------------------------------------


def delete_records(spark: SparkSession, store: UsageStore, ids: DataFrame, now: dt.datetime | None = None) -> None:
    """Delete usage rows by message id: tombstones (read-time anti-join), and what the live totals lose.

    Only the days of the deleted ids are read.  Tombstones are kept after compaction too,
    and ids are never forgotten, so a re-read file cannot bring a deleted message back.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    with staging(spark):
        recover(spark, store)
        ids = staged(ids.select("message_id").distinct(), "delete-ids")
        stored = stored_ids(spark, store)
        live = read_usage(spark, store).select("message_id", "usage_date", "ts", "model", *TOKEN_COLUMNS)
        if stored is not None:
            days = staged(_days(among_stored(stored, ids).where("usage_date is not null")), "delete-days")
            live = live.join(days, "usage_date", "left_semi")
        intent = f"{store.intents}/delete-{uuid.uuid4().hex}"
        ids.join(live, "message_id", "left").withColumn("deleted_at", F.lit(now)).write.parquet(intent)
        _apply_delete(spark, store, intent)


def live_totals(spark: SparkSession, store: UsageStore, bucket: str = "hour") -> DataFrame:
    """(usage_date, bucket, model, measures) of the live facts, from the stored deltas."""
    return TotalsLog(spark, store.totals).totals(bucket)


def compact(spark: SparkSession, store: UsageStore) -> int:
    """Rewrite only the date partitions that hold tombstoned rows; returns their count.

    The surviving rows of those partitions are staged in the store first (so the
    overwrite never reads the path it writes, and a run that dies in it is finished by the next)
    and then replace exactly those partitions (dynamic partition overwrite).  A day that has no
    survivor is removed as a whole, so deleted rows leave storage.  Ids and totals are
    compacted too.  Run it while nothing appends to the same days.
    """
    with staging(spark):
        recover(spark, store)
        TotalsLog(spark, store.totals).compact()
        compact_ids(spark, store)
        if not (path_exists(spark, store.usage) and path_exists(spark, store.tombstones)):
            return 0
        scratch_dir(spark)
        usage = spark.read.schema(USAGE).parquet(store.usage)
        dead = spark.read.parquet(store.tombstones).select("message_id").distinct()
        dates = staged(_days(usage.join(dead, "message_id", "left_semi")), "compact-days")
        n = dates.count()
        if n == 0:
            return 0
        keep = usage.join(dates, "usage_date", "left_semi").join(dead, "message_id", "left_anti")
        intent = f"{store.intents}/compact-{uuid.uuid4().hex}"
        # A day without a survivor has one row without an id.
        keep.select(*[f.name for f in USAGE.fields]).unionByName(dates, allowMissingColumns=True).write.parquet(intent)
        _apply_compact(spark, store, intent)
        return n


def _apply_compact(spark: SparkSession, store: UsageStore, path: str) -> None:
    """Replace the days of a compaction intent; doing it twice changes nothing."""
    rows = spark.read.schema(USAGE).parquet(path)
    keep, days = rows.where("message_id is not null"), _days(rows)
    sorted_days = keep.hint("rebalance", "usage_date").sortWithinPartitions("usage_date", "session_id", "ts")
    sorted_days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date").parquet(store.usage)
    emptied = days.join(_days(keep), "usage_date", "left_anti")
    for r in emptied.collect():  # calendar days
        delete_path(spark, os.path.join(store.usage, f"usage_date={r.usage_date}"))
    delete_path(spark, path)
