"""Scalar Column expressions: keys, time parsing and buckets, derived metrics.

All are built-in expressions (codegen'd, JVM-side).  Divisions are guarded
with ``when`` so they never raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ZERO_TIME

# --- fixed values -----------------------------------------------------------
DAY_KEY_FORMAT = "yyyy-MM-dd"
HOUR_KEY_FORMAT = "yyyy-MM-dd HH:00:00"
RFC3339_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
BUDGET_WARN_PCT = 80.0
BUDGET_OVER_PCT = 100.0
DETACHED_BRANCH = "HEAD"
# Layouts accepted when reading stored time text, in order of preference.
STORED_TIME_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
]
# ---------------------------------------------------------------------------


def project_key(cwd: Column | None = None, slug: Column | None = None) -> Column:
    """Project identity: the working directory when non-empty, else the slug."""
    cwd = F.col("cwd") if cwd is None else cwd
    slug = F.col("project_slug") if slug is None else slug
    return F.coalesce(F.nullif(cwd, F.lit("")), slug)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def instant_to_utc_ntz(instant: Column) -> Column:
    """A zoned timestamp as UTC wall-clock time, independent of the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def rfc3339_to_utc(text: Column) -> Column:
    """Strict RFC 3339 text -> UTC NTZ timestamp; null when malformed.

    Fractions beyond microseconds are truncated.
    """
    return F.when(text.rlike(RFC3339_TEXT), instant_to_utc_ntz(F.try_to_timestamp(text)))


def stored_time(text: Column) -> Column:
    """Stored time text in one of the accepted layouts, else null.

    Writers keep up to nanoseconds; digits beyond microseconds are cut.
    """
    text = F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1")
    parsed = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in STORED_TIME_LAYOUTS]
    return instant_to_utc_ntz(F.coalesce(*parsed))


def zero_time() -> Column:
    return F.lit(ZERO_TIME).cast("timestamp_ntz")


def bucket_key(ts: Column, bucket: str) -> Column:
    """``YYYY-MM-DD`` for day buckets, ``YYYY-MM-DD HH:00:00`` for hour; other names -> day."""
    return F.date_format(ts, HOUR_KEY_FORMAT if bucket == "hour" else DAY_KEY_FORMAT)


def pct_change(current: Column, previous: Column) -> Column:
    """(a - b) / b x 100; with b = 0: infinity when a > 0, else 0."""
    a, b = current.cast("double"), previous.cast("double")
    return (
        F.when(b.isNull() | (b == 0), F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        .otherwise((a - b) / b * 100.0)
    )


def change_direction(pct: Column) -> Column:
    """up / down / flat, ``new`` when infinite, null when missing."""
    return (
        F.when(pct.isNull(), F.lit(None).cast("string"))
        .when(pct == F.lit(float("inf")), F.lit("new"))
        .when(pct > 0, F.lit("up"))
        .when(pct < 0, F.lit("down"))
        .otherwise(F.lit("flat"))
    )


def budget_pct_used(spent: Column, amount: Column) -> Column:
    return F.when(amount > 0, spent / amount * 100.0).otherwise(F.lit(0.0))


def budget_status(pct: Column) -> Column:
    return (
        F.when(pct >= BUDGET_OVER_PCT, F.lit("over"))
        .when(pct >= BUDGET_WARN_PCT, F.lit("warn"))
        .otherwise(F.lit("ok"))
    )


def budget_bar_pct(pct: Column) -> Column:
    return F.least(F.lit(BUDGET_OVER_PCT), pct)


def share_pct(value: Column, total: Column) -> Column:
    return F.when(total != 0, value.cast("double") / total * 100.0).otherwise(F.lit(0.0))


def slug_to_path(slug: Column) -> Column:
    """``-a-b`` -> ``/a/b``; text not starting with a dash is unchanged."""
    path = F.concat(F.lit("/"), F.replace(F.substring(slug, 2, 1 << 30), F.lit("-"), F.lit("/")))
    return F.when(slug.isNull(), F.lit("")).when(slug.startswith("-"), path).otherwise(slug)


def has_branch(branch: Column) -> Column:
    return branch.isNotNull() & (branch != "") & (branch != F.lit(DETACHED_BRANCH))


def cache_total(write: Column | None = None, read: Column | None = None) -> Column:
    write = F.col("cache_creation_tokens") if write is None else write
    read = F.col("cache_read_tokens") if read is None else read
    return read + write
