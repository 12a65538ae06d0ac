"""JSONL session-log source: scan, number, decode, split good / quarantine.

Layout: ``<root>/<project_slug>/.../<name>.jsonl``; one JSON object per line.

* Scan: the text source over the root (recursive, ``*.jsonl``), one row per
  ``\\n``-terminated line, blank lines included, with the file path and the
  start of the split (block) each line was read from.  File names never go
  through the driver or back into a path, so any name is read.
* A file that cannot be read, or only in part, does not stop the others.
  ``file_totals`` compares the bytes of the lines with the file's size; files
  that were not read whole are left out of the load and tried again.
* Line numbers (1-based per file, blanks counted) without sending a file to
  one task: lines are counted per (file, block) -- a map-side combined
  aggregate with one row per block -- a prefix sum over each file's blocks
  gives the lines before each block, and the within-block position comes
  from ``monotonically_increasing_id`` (a block's lines are contiguous in one
  partition).  A file of any size is therefore numbered by as many tasks as
  it has blocks.
* Decode: ``from_json`` with an explicit schema; a line with a type error
  anywhere (text where a number belongs, 1.5 for an integer) or that is not
  JSON is quarantined, as is a usage line whose timestamp is present but not
  RFC 3339.  Lines that are valid JSON but not assistant usage are skipped.
"""

from __future__ import annotations

import datetime as dt
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import empty_to_null, project_key, rfc3339_to_utc, zero_time
from ..schemas import ASSISTANT_TYPE, LOG_LINE_WITH_CORRUPT, USAGE

# --- fixed values -----------------------------------------------------------
LOG_GLOB = "*.jsonl"
LINE_SEPARATOR = "\n"
# ---------------------------------------------------------------------------


def root_path(root: str) -> str:
    """The path part of a root URI or local path, without a trailing slash."""
    p = urlparse(root)
    path = p.path if p.scheme else root
    return path.rstrip("/") or "/"


def decoded_path(uri: Column) -> Column:
    """File URI from the scan as a plain path: URI-decoded, ``file:`` dropped.

    The scan's path is URI-encoded (space -> %20) but keeps ``+`` literal,
    while url_decode reads ``+`` as a space, so ``+`` is protected first.
    """
    dec = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(dec, r"^file:(//)?", "")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` (the text after the first ``<root>/``)."""
    rp = root_path(root).rstrip("/")
    pos = F.locate(rp + "/", path)
    return F.when(pos > 0, F.substring(path, pos + len(rp) + 1, 1 << 30)).otherwise(path)


def scan_lines(spark: SparkSession, root: str, glob: str = LOG_GLOB, since: dt.datetime | None = None) -> DataFrame:
    """Raw lines with (source_file, block_start, row_id, modified_at, file_size).

    ``since`` prunes files modified before it when the scan is planned.
    """
    df = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", LINE_SEPARATOR)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .text(root)
    )
    if since is not None:
        df = df.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return with_file_columns(df).withColumn("row_id", F.monotonically_increasing_id())


def with_file_columns(df: DataFrame) -> DataFrame:
    """The line and the scan's metadata of its file."""
    return df.select(
        F.col("value"),
        decoded_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def block_totals(lines: DataFrame) -> DataFrame:
    """Per (file, split): first row id, number of lines, bytes of lines with their separators, the last line's
    bytes, and the bytes and checksum of the file's first line.

    All are plain numbers, so the lines are aggregated by hash and not sorted first.
    """
    if "n_bytes" not in lines.columns:
        lines = lines.withColumn("n_bytes", F.octet_length("value").cast("bigint"))
    lines = _resumed(lines)
    return lines.groupBy("source_file", "block_start").agg(
        F.min("row_id").alias("first_id"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("n_bytes") + 1).alias("n_bytes"),
        F.max_by("n_bytes", "row_id").alias("last_bytes"),
        F.min_by("n_bytes", "row_id").alias("head_bytes"),
        F.min_by("line_crc", "row_id").alias("head_crc"),
        F.max("file_size").alias("file_size"),
        F.max("modified_at").alias("modified_at"),
        F.max("base_offset").alias("base_offset"),
        F.max("base_line").alias("base_line"),
    )


def _resumed(lines: DataFrame) -> DataFrame:
    """Lines with the offset and line that their range resumes at; a whole file starts at 0."""
    defaults = {"base_offset": F.lit(0).cast("bigint"), "base_line": F.lit(0).cast("bigint"), "line_crc": F.lit(None).cast("bigint")}
    return lines.withColumns({c: v for c, v in defaults.items() if c not in lines.columns})


def file_totals(blocks: DataFrame) -> DataFrame:
    """Per file: lines, size, whether every byte was read (a last line may lack its separator), and where to resume.

    ``resume_offset`` and ``resume_line`` stand behind the last line that has its separator:
    a line still being written is read now and again when it is whole.
    """
    files = blocks.groupBy("source_file").agg(
        (F.sum("n") + F.max("base_line")).alias("last_line"),
        (F.sum("n_bytes") + F.max("base_offset")).alias("n_bytes"),
        F.max_by("last_bytes", "block_start").alias("last_bytes"),
        F.min_by("head_bytes", "block_start").alias("head_bytes"),
        F.min_by("head_crc", "block_start").alias("head_crc"),
        F.max("file_size").alias("byte_offset"),
        F.max("modified_at").alias("modified_at"),
        F.max("base_offset").alias("base_offset"),
    )
    open_tail = F.col("n_bytes") == F.col("byte_offset") + 1
    return files.select(
        "source_file", "last_line", "byte_offset", "modified_at", "base_offset", open_tail.alias("open_tail"),
        ((F.col("n_bytes") == F.col("byte_offset")) | open_tail).alias("whole"),
        (F.col("byte_offset") - F.when(open_tail, F.col("last_bytes")).otherwise(0)).alias("resume_offset"),
        (F.col("last_line") - F.when(open_tail, 1).otherwise(0)).alias("resume_line"),
        "head_bytes", "head_crc",
    )


def number_lines(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Add the 1-based per-file ``source_line`` (blank lines counted); ranges go on from the line they resume at.

    The table of splits has one row a split; its join carries no hint, so its
    known size decides whether it is broadcast.
    """
    blocks = block_totals(lines) if blocks is None else blocks
    w = Window.partitionBy("source_file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "source_file", "block_start", "first_id", (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("base_line")).alias("lines_before")
    )
    out = lines.join(before, ["source_file", "block_start"])
    return out.withColumn("source_line", F.col("lines_before") + (F.col("row_id") - F.col("first_id")) + 1).drop(
        "first_id", "lines_before"
    )


def decode(lines: DataFrame) -> DataFrame:
    """Parse lines; adds ``j`` (the struct) and ``reject_reason`` (blank lines are no usage)."""
    parsed = lines.withColumn(
        "j", F.from_json("value", LOG_LINE_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    is_usage = (
        (F.col("j.type") == F.lit(ASSISTANT_TYPE))
        & F.col("j.message").isNotNull()
        & F.col("j.message.usage").isNotNull()
        & (F.coalesce(F.col("j.message.id"), F.lit("")) != "")
    )
    bad_ts = F.col("j.timestamp").isNotNull() & rfc3339_to_utc(F.col("j.timestamp")).isNull()
    reason = (
        F.when(F.length("value") == 0, F.lit("not_usage"))
        .when(F.col("j").isNull() | F.col("j._corrupt").isNotNull(), F.lit("malformed_json"))
        .when(is_usage & bad_ts, F.lit("bad_timestamp"))
        .when(~is_usage, F.lit("not_usage"))
    )
    return parsed.withColumn("reject_reason", reason)


KEPT_REASONS = ["malformed_json", "bad_timestamp"]


def decoded_lines(lines: DataFrame) -> DataFrame:
    """One row a line, decoded once: what numbering, the fact rows, the quarantine and the manifest need of it.

    Only usage lines carry the struct and only rejected lines their text.
    """
    if "n_bytes" not in lines.columns:
        lines = lines.withColumn("n_bytes", F.octet_length("value").cast("bigint"))
    dec = decode(_resumed(lines))
    return dec.select(
        "source_file",
        "block_start",
        "row_id",
        "file_size",
        "modified_at",
        "n_bytes",
        "base_offset",
        "base_line",
        # Of the split a file begins with: its first line tells whether the file is still the same.
        F.when(F.col("block_start") == 0, F.crc32("value")).alias("line_crc"),
        "reject_reason",
        F.when(F.col("reject_reason").isNull(), F.col("j").dropFields("_corrupt")).alias("j"),
        F.when(F.col("reject_reason").isin(KEPT_REASONS), F.col("value")).alias("value"),
    )


def to_usage(decoded: DataFrame, root: str) -> DataFrame:
    """Good usage lines -> fact rows (empty request/cwd/branch -> null)."""
    good = decoded.filter(F.col("reject_reason").isNull())
    rel = relative_path(F.col("source_file"), root)
    slug = F.split(rel, "/").getItem(0)
    u = F.col("j.message.usage")
    ts = F.when(F.col("j.timestamp").isNull(), zero_time()).otherwise(rfc3339_to_utc(F.col("j.timestamp")))
    df = good.select(
        F.col("j.message.id").alias("message_id"),
        empty_to_null(F.col("j.requestId")).alias("request_id"),
        F.coalesce(F.col("j.sessionId"), F.lit("")).alias("session_id"),
        slug.alias("project_slug"),
        empty_to_null(F.col("j.cwd")).alias("cwd"),
        empty_to_null(F.col("j.gitBranch")).alias("git_branch"),
        F.coalesce(F.col("j.message.model"), F.lit("")).alias("model"),
        ts.alias("ts"),
        F.coalesce(u.input_tokens, F.lit(0)).alias("input_tokens"),
        F.coalesce(u.output_tokens, F.lit(0)).alias("output_tokens"),
        F.coalesce(u.cache_creation_input_tokens, F.lit(0)).alias("cache_creation_tokens"),
        F.coalesce(u.cache_read_input_tokens, F.lit(0)).alias("cache_read_tokens"),
        F.col("source_file"),
        F.col("source_line"),
        F.split(rel, "/").alias("path_parts"),
    )
    df = df.withColumn("project_key", project_key()).withColumn("usage_date", F.to_date("ts"))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in USAGE.fields], "path_parts")


def quarantine(decoded: DataFrame, *more: Column | str) -> DataFrame:
    """Rejected lines with their reason (JSON that is simply not usage is not kept)."""
    return decoded.filter(F.col("reject_reason").isin(KEPT_REASONS)).select(
        "source_file", "source_line", F.col("reject_reason").alias("reason"), F.col("value").alias("line"), *more
    )


def first_wins(usage_with_parts: DataFrame) -> DataFrame:
    """One row per message id: the first in (path components, line) order.

    Directory walks visit names in lexical order per component, so the
    order key is the array of path components, not the path string.  The
    aggregate combines map-side, so a message id repeated across a third of
    all lines is reduced inside each map task.
    """
    cols = [f.name for f in USAGE.fields]
    key = F.struct(F.col("path_parts"), F.col("source_line"))
    picked = usage_with_parts.groupBy("message_id").agg(
        F.min_by(F.struct(*[F.col(c) for c in cols if c != "message_id"]), key).alias("r")
    )
    return picked.select("message_id", "r.*").select(*cols)
