"""Stored day totals whose distinct sessions roll up exactly.

Sums of days add up to the sums of a window; distinct counts do not.  Sessions get
numbers, and a day's sessions of a project are a bitmap over them, so the sessions
of any window are the OR of its days' bitmaps and their count is exact.

    sessions/  session_id -> number, dense from 0, an append log by batch
    tokens/    (usage_date, project_key, model): token sums and messages
    bitmaps/   (usage_date, project_key, part): the sessions of 32,768 numbers each, as bits

All of it is built from the facts without the placeholder model, by whole days: ``refresh`` numbers the
sessions that are new and replaces the given days.  A window then reads days x projects rows, no fact.
Numbers are given by counts of hash slots and a rank inside them, so no task sees all sessions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import UsageFilter, from_date, not_synthetic, to_date_exclusive
from ..operators import aggregates as A
from ..operators.rates import as_sheet, price_groups, sum_tokens
from ..schemas import TOKEN_COLUMNS
from ..sources.tables import finished_paths, staged, staging

#: Sessions are ranked inside this many hash slots; the slots' counts give each its first number.
SLOTS = 4096
SCHEMAS = {
    "tokens": "project_key string, model string, " + "".join(f"{c} bigint, " for c in [*TOKEN_COLUMNS, "messages"]) + "usage_date date",
    "bitmaps": "project_key string, part bigint, sessions binary, usage_date date",
}


def summary_of(models: DataFrame, sessions: DataFrame, rates) -> DataFrame:
    """The summary report from the totals by model and a one-row session count."""
    priced = price_groups(models, [], as_sheet(rates))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in [*TOKEN_COLUMNS, "messages"]]
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")
    return priced.agg(*sums, cost).select(*TOKEN_COLUMNS, sessions.scalar().alias("sessions"), "messages", "cost_usd")


class DayRollup:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _sessions(self) -> DataFrame | None:
        paths = finished_paths(self.spark, f"{self.base}/sessions")
        return self.spark.read.schema("session_id string, number bigint").parquet(*paths) if paths else None

    def _number(self, found: DataFrame) -> DataFrame:
        """Numbers of all sessions, the new ones of ``found`` added."""
        known = self._sessions()
        fresh = found if known is None else found.join(known, "session_id", "left_anti")
        fresh = staged(fresh.select("session_id", F.pmod(F.xxhash64("session_id"), F.lit(SLOTS)).alias("slot")), "rollup-new")
        if fresh.head(1):
            first = 0 if known is None else known.agg(F.max("number") + 1).scalar()
            before = F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
            slots = fresh.groupBy("slot").agg(F.count("*").alias("n"))  # SLOTS rows at most
            slots = slots.select("slot", F.coalesce(before, F.lit(0)).alias("before"))
            rank = F.row_number().over(Window.partitionBy("slot").orderBy("session_id")) - 1
            rows = fresh.join(slots, "slot").select("session_id", (first + F.col("before") + rank).cast("bigint").alias("number"))
            rows.write.parquet(f"{self.base}/sessions/{uuid.uuid4().hex}")
        known = self._sessions()
        return self.spark.createDataFrame([], "session_id string, number bigint") if known is None else known

    def refresh(self, usage: DataFrame, days: DataFrame | None = None) -> None:
        """Replace the given days (``usage_date``; all if None) by those of ``usage``; one writer at a time."""
        with staging(self.spark):
            rows = usage.where(not_synthetic())
            if days is not None:
                rows = rows.join(days, "usage_date", "left_semi")
            keys = ["usage_date", "project_key"]
            fine = staged(rows.groupBy(*keys, "model", "session_id").agg(*sum_tokens(), F.count("*").alias("messages")), "rollup-fine")
            numbers = self._number(fine.select("session_id").distinct())
            sums = [F.sum(c).cast("bigint").alias(c) for c in [*TOKEN_COLUMNS, "messages"]]
            self._replace(fine.groupBy(*keys, "model").agg(*sums), days, "tokens")
            bits = fine.select(*keys, "session_id").distinct().join(numbers, "session_id")
            part, bit = F.bitmap_bucket_number("number").alias("part"), F.bitmap_bit_position("number").alias("bit")
            bits = bits.select(*keys, part, bit).groupBy(*keys, "part").agg(F.bitmap_construct_agg("bit").alias("sessions"))
            self._replace(bits, days, "bitmaps")

    def _replace(self, rows: DataFrame, days: DataFrame | None, name: str) -> None:
        path = f"{self.base}/{name}"
        if days is None:
            rows.write.mode("overwrite").partitionBy("usage_date").parquet(path)
            return
        # A day that has no row any more is replaced too, by one without a project.
        rows = staged(rows, f"rollup-{name}")
        empty = days.select("usage_date").distinct().join(rows, "usage_date", "left_anti")
        rows = rows.unionByName(empty, allowMissingColumns=True)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date").parquet(path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{name}")

    def tokens(self) -> DataFrame:
        """All stored day totals; a day that lost its rows has one without a project and model."""
        return self._read("tokens")

    def _days(self, name: str, f: UsageFilter | None) -> DataFrame:
        """Stored rows of a window; the filter may name days and a project."""
        f = f or UsageFilter()
        if f.model or f.search:
            raise ValueError("the stored days know no model of a session and no text")
        rows = self._read(name).where("project_key is not null")
        lo, hi = from_date(f.date_from), to_date_exclusive(f.date_to)
        if lo:
            rows = rows.where(F.col("usage_date") >= F.lit(lo))
        if hi:
            rows = rows.where(F.col("usage_date") < F.lit(hi))
        return rows.where(F.col("project_key") == F.lit(f.project)) if f.project else rows

    def sessions(self, f: UsageFilter | None = None, keys: list[str] | None = None) -> DataFrame:
        """Distinct sessions of a window, by project or in all: one OR over the days, one count over the parts."""
        keys = keys or []
        ored = self._days("bitmaps", f).groupBy(*keys, "part").agg(F.bitmap_or_agg("sessions").alias("bits"))
        return ored.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("sessions"))

    def summary(self, rates, f: UsageFilter | None = None) -> DataFrame:
        """The summary report (R-01) of a window of days."""
        measures = [*TOKEN_COLUMNS, "messages"]
        models = self._days("tokens", f).groupBy("model").agg(*[F.sum(c).cast("bigint").alias(c) for c in measures])
        return summary_of(models, self.sessions(f), rates)

    def project_ranking(self, rates, f: UsageFilter | None = None) -> DataFrame:
        """The project ranking (R-06) of a window of days."""
        measures = [*TOKEN_COLUMNS, "messages"]
        pm = self._days("tokens", f).groupBy("project_key", "model").agg(*[F.sum(c).cast("bigint").alias(c) for c in measures])
        projects = A.project_rollup(price_groups(pm, ["project_key"], as_sheet(rates)))
        out = projects.join(self.sessions(f, ["project_key"]), "project_key")
        return out.select("project_key", "models", *measures, "sessions", "cost_usd").orderBy(F.desc("cost_usd"), F.asc("project_key"))
