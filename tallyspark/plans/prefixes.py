"""Window totals as differences of stored running totals.

    prefixes/  (usage_date, model): token sums and messages of all days up to and with this one

Every stored day holds every model seen so far, so the totals of a window are two
look-ups, the last day before its end minus the last day before its start, however long
the window is.  Distinct sessions do not subtract; they come from the rollup's bitmaps.

It is built from the day totals of a ``DayRollup``, never from the facts.  ``refresh``
takes the first day that changed: running totals go on from the day before it, and
only that day and later ones are replaced, so late rows and deletes leave earlier days alone.
One writer at a time; after a lost driver the same refresh runs again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import UsageFilter, from_date, previous_period, to_date_exclusive
from ..schemas import TOKEN_COLUMNS
from ..sources.tables import partition_values, staged, staging
from .reports import compared
from .rollups import DayRollup, summary_of

MEASURES = [*TOKEN_COLUMNS, "messages"]
SCHEMA = "model string, " + ", ".join(f"{c} bigint" for c in MEASURES)


class PrefixTotals:
    def __init__(self, spark: SparkSession, base: str, rollup: DayRollup):
        self.spark, self.path, self.rollup = spark, f"{base}/prefixes", rollup

    def _before(self, bound: str | None) -> DataFrame:
        """Running totals by model at the end of the last stored day before ``bound`` (None: of all days)."""
        days = [d for d in partition_values(self.spark, self.path, "usage_date") if bound is None or d < bound]
        if not days:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/usage_date={days[-1]}").where("model is not null")

    def refresh(self, since: dt.date | None = None) -> None:
        """Replace the running totals of ``since`` and all later days (all days if None)."""
        with staging(self.spark):
            rows = self.rollup.tokens()
            if since is not None:
                rows = rows.where(F.col("usage_date") >= F.lit(since))
            # Days that lost all rows have one row without a model, so they stay and carry the day before on.
            sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in MEASURES]
            rows = staged(rows.groupBy("usage_date", "model").agg(*sums), "prefix-days")
            # A row a calendar day: the one window without a partition is over these.
            at = F.row_number().over(Window.orderBy("usage_date")).alias("at")
            days = staged(rows.select("usage_date").distinct().select("usage_date", at), "prefix-calendar")
            rows = rows.join(days, "usage_date").select("at", "model", *MEASURES)
            if since is not None:
                rows = rows.unionByName(self._before(since.isoformat()).withColumn("at", F.lit(0)))
            by_model = Window.partitionBy("model").orderBy("at")  # at most a row a day
            until = F.coalesce(F.lead("at").over(by_model) - 1, days.agg(F.max("at")).scalar())
            running = rows.select("at", "model", until.alias("until"), *[F.sum(c).over(by_model).alias(c) for c in MEASURES])
            # A model holds its totals until its next day with rows; position 0 is the stored day before ``since``.
            held = running.where("until >= greatest(at, 1)").withColumn("at", F.expr("explode(sequence(greatest(at, 1), until))"))
            out = held.join(days, "at").select("usage_date", "model", *MEASURES).repartition("usage_date")
            writer = out.write.mode("overwrite").partitionBy("usage_date")
            (writer if since is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(self.path)

    def totals(self, f: UsageFilter | None = None) -> DataFrame:
        """(model, measures) of a window of days: two look-ups; models without a message in it are left out."""
        f = f or UsageFilter()
        if f.project or f.model or f.search:
            raise ValueError("running totals know days and models only")
        lo, hi = from_date(f.date_from), to_date_exclusive(f.date_to)
        rows = self._before(str(hi) if hi else None)
        if lo and hi and str(lo) >= str(hi):
            rows = rows.limit(0)
        elif lo:
            start = self._before(str(lo)).select("model", *[(-F.col(c)).alias(c) for c in MEASURES])
            rows = rows.unionByName(start)
        return rows.groupBy("model").agg(*[F.sum(c).cast("bigint").alias(c) for c in MEASURES]).where("messages <> 0")

    def summary(self, rates, f: UsageFilter | None = None) -> DataFrame:
        """The summary report (R-01) of a window of days."""
        return summary_of(self.totals(f), self.rollup.sessions(f), rates)

    def period_comparison(self, rates, f: UsageFilter | None, as_of: dt.datetime) -> DataFrame | None:
        """The period comparison (R-09) of a window of days; None when it has no length."""
        f = f or UsageFilter()
        cmp = previous_period(f.date_from, f.date_to, as_of)
        if cmp is None:
            return None
        cur = self.summary(rates, f.with_bounds(cmp.current_from, cmp.current_to))
        return compared(cur, self.summary(rates, f.with_bounds(cmp.previous_from, cmp.previous_to)), cmp.label)
