"""Price sheet maintenance: feed normalisation, sync merge, seeding, edits.

Sheets are small dimension tables, but nothing here assumes it: every step
is a join on the model key or a keyed aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import feed as FD
from ..operators.keyed import delete_keys, keyed_union, last_per_key, upsert, with_status
from ..schemas import PRICING, RATE_COLUMNS, SOURCE_FEED, SOURCE_MANUAL, SOURCE_SEED

# --- fixed values -----------------------------------------------------------
# Built-in rates seeded when absent: (model, input, output, cache write,
# cache read) in USD per million tokens.
DEFAULT_RATES = [
    ("claude-opus-4-7", 15.0, 75.0, 18.75, 1.5),
    ("claude-opus-4-6", 15.0, 75.0, 18.75, 1.5),
    ("claude-opus-4-5", 15.0, 75.0, 18.75, 1.5),
    ("claude-opus-4", 15.0, 75.0, 18.75, 1.5),
    ("claude-sonnet-4-6", 3.0, 15.0, 3.75, 0.3),
    ("claude-sonnet-4-5", 3.0, 15.0, 3.75, 0.3),
    ("claude-sonnet-4", 3.0, 15.0, 3.75, 0.3),
    ("claude-haiku-4-5", 1.0, 5.0, 1.25, 0.1),
]
# ---------------------------------------------------------------------------

SHEET_COLUMNS = [f.name for f in PRICING.fields]


def _ts(now: dt.datetime):
    return F.lit(now).cast("timestamp_ntz")


def normalise_feed(feed: DataFrame, now: dt.datetime, prefix: str = FD.VENDOR_PREFIX) -> DataFrame:
    """Feed entries -> candidate sheet rows (source = feed, fetched_at = now).

    Keeps vendor ids without a variant suffix, turns dots into dashes,
    converts per-token prices, drops free entries and fills missing cache
    prices.  When two entries meet on one model id the later one wins.
    """
    f = feed.filter(FD.is_vendor_model(F.col("id"), prefix)).select(
        "pos",
        FD.normalised_model(F.col("id"), prefix).alias("model"),
        FD.per_million(F.col("prompt")).alias("input_per_mtok_usd"),
        FD.per_million(F.col("completion")).alias("output_per_mtok_usd"),
        FD.per_million(F.col("input_cache_write")).alias("w"),
        FD.per_million(F.col("input_cache_read")).alias("r"),
    )
    f = f.filter(~FD.is_free(F.col("input_per_mtok_usd"), F.col("output_per_mtok_usd")))
    f = f.select(
        "pos",
        "model",
        "input_per_mtok_usd",
        "output_per_mtok_usd",
        FD.default_cache_write(F.col("w"), F.col("input_per_mtok_usd")).alias("cache_write_per_mtok_usd"),
        FD.default_cache_read(F.col("r"), F.col("input_per_mtok_usd")).alias("cache_read_per_mtok_usd"),
    )
    last = f.groupBy("model").agg(F.max_by(F.struct(*RATE_COLUMNS), "pos").alias("x")).select("model", "x.*")
    return last.select(
        "model", *RATE_COLUMNS, F.lit(SOURCE_FEED).alias("source"), _ts(now).alias("fetched_at"), _ts(now).alias("updated_at")
    )


def sync_actions(sheet: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """Each normalised feed row with its action: inserted / updated / skipped_manual."""
    old = sheet.select(F.col("model").alias("_m"), F.coalesce("source", F.lit(SOURCE_MANUAL)).alias("_src"))
    j = feed_rows.join(old, F.col("model") == F.col("_m"), "left")
    action = (
        F.when(F.col("_m").isNull(), F.lit("inserted"))
        .when(F.col("_src") == SOURCE_MANUAL, F.lit("skipped_manual"))
        .otherwise(F.lit("updated"))
    )
    return j.withColumn("action", action).drop("_m", "_src")


def sync(sheet: DataFrame, feed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sheet, one-row counters).  Manual rows are never replaced."""
    acts = sync_actions(sheet, feed_rows)
    applied = acts.filter(F.col("action") != "skipped_manual").select(*SHEET_COLUMNS)
    new_sheet = upsert(sheet.select(*SHEET_COLUMNS), applied, "model")
    counters = acts.agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action") == "skipped_manual").alias("skipped_manual"),
        F.max("fetched_at").alias("fetched_at"),
    )
    return new_sheet, counters


def defaults(spark: SparkSession, now: dt.datetime) -> DataFrame:
    rows = [(m, i, o, w, r, SOURCE_SEED, None, now) for (m, i, o, w, r) in DEFAULT_RATES]
    return spark.createDataFrame(rows, PRICING)


def seed_missing(spark: SparkSession, sheet: DataFrame, now: dt.datetime) -> DataFrame:
    """Add the default rows whose model is absent (source = seed)."""
    return keyed_union(sheet.select(*SHEET_COLUMNS), defaults(spark, now), "model")


def upsert_rates(sheet: DataFrame, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Insert or replace by model (the last row of a model wins); source defaults to manual, updated_at = now."""
    r = last_per_key(rows, "model").withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(SOURCE_MANUAL)))
    r = r.withColumn("updated_at", _ts(now))
    return upsert(sheet.select(*SHEET_COLUMNS), r.select(*SHEET_COLUMNS), "model")


def create_rates(sheet: DataFrame, rows: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Strict create: a model that exists is a conflict; new rows are manual.

    Model ids are trimmed and must be non-empty.  Within one change set the
    first change (by ``pos`` when given) for a model creates it and later
    ones conflict.  Returns (new sheet, per-change status).
    """
    r = rows.withColumn("model", F.trim("model"))
    if "pos" not in r.columns:
        r = r.withColumn("pos", F.lit(0).cast("bigint"))
    status = with_status(r, sheet, "model", "conflict", "created")
    first = F.row_number().over(Window.partitionBy("model").orderBy("pos", *RATE_COLUMNS))
    status = status.withColumn(
        "status",
        F.when(F.col("model") == "", F.lit("invalid"))
        .when((F.col("status") == "created") & (first > 1), F.lit("conflict"))
        .otherwise(F.col("status")),
    )
    created = (
        status.filter(F.col("status") == "created")
        .withColumn("source", F.lit(SOURCE_MANUAL))
        .withColumn("fetched_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("updated_at", _ts(now))
    )
    return keyed_union(sheet.select(*SHEET_COLUMNS), created.select(*SHEET_COLUMNS), "model"), status.select("pos", "model", "status")


def update_rates(sheet: DataFrame, rows: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Strict update: unknown model is not_found; source kept, fetched_at cleared.

    Every edit gets its status; of several edits of a model the last stays.
    """
    status = with_status(rows, sheet, "model", "updated", "not_found")
    old_src = sheet.select("model", F.col("source").alias("_old_source"))
    upd = (
        last_per_key(status.filter(F.col("status") == "updated"), "model")
        .join(old_src, "model")
        .withColumn("source", F.col("_old_source"))
        .withColumn("fetched_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("updated_at", _ts(now))
    )
    return upsert(sheet.select(*SHEET_COLUMNS), upd.select(*SHEET_COLUMNS), "model"), status.select("model", "status")


def delete_rates(sheet: DataFrame, models: DataFrame) -> DataFrame:
    return delete_keys(sheet, models, "model")
