"""Live totals as signed deltas: (day, hour, model) rows that inserts add and deletes take away.

Each load or delete has an id and commits its deltas once, under the name of its
attempt; readers take one finished attempt an id.  Totals are the sum of the rows, so a late row
or a delete changes them without a day being read again.  ``compact`` folds commits into a
new version of the totals, with the ids it holds, and removes what it folded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket_key
from ..operators.aggregates import with_bucket
from ..schemas import TOKEN_COLUMNS
from ..sources.tables import committed_versions, delete_path, finished_paths, read_latest, write_version

MEASURES = [*TOKEN_COLUMNS, "messages"]
SCHEMA = "usage_date date, hour string, model string, " + ", ".join(f"{c} bigint" for c in MEASURES)


def deltas(usage: DataFrame, sign: int) -> DataFrame:
    """Signed totals of fact rows by day, hour and model."""
    rows = with_bucket(usage, "hour").withColumnRenamed("bucket", "hour").withColumn("messages", F.lit(1))
    return rows.groupBy("usage_date", "hour", "model").agg(*[(F.sum(c) * sign).cast("bigint").alias(c) for c in MEASURES])


class TotalsLog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    @property
    def _commits(self) -> str:
        return f"{self.base}/commits"

    @property
    def _folded(self) -> str:
        return f"{self.base}/totals"

    def attempts(self) -> dict[str, str]:
        """One finished attempt of each id that is not folded yet (of several the least, which all readers take)."""
        found: dict[str, str] = {}
        for path in finished_paths(self.spark, self._commits):
            found.setdefault(path.rsplit("/", 1)[1].split("~")[0], path)
        folded = self._folded_ids()
        if folded is not None and found:
            mine = self.spark.createDataFrame([(i,) for i in found], "id string")
            for r in mine.join(folded, "id", "left_semi").collect():  # at most one an attempt that is still there
                del found[r.id]
        return found

    def _folded_ids(self) -> DataFrame | None:
        last = read_latest(self.spark, self._folded)
        return None if last is None else last.where("id is not null").select("id")

    def commit(self, id: str, rows: DataFrame) -> None:
        """Add the deltas of ``id``; does nothing if they count already."""
        if id not in self.attempts() and not self._is_folded(id):
            rows.write.parquet(f"{self._commits}/{id}~{uuid.uuid4().hex}")

    def _is_folded(self, id: str) -> bool:
        folded = self._folded_ids()
        return folded is not None and bool(folded.where(F.col("id") == id).head(1))

    def _rows(self, attempts: dict[str, str]) -> DataFrame:
        last = read_latest(self.spark, self._folded)
        out = self.spark.createDataFrame([], SCHEMA) if last is None else last.where("id is null").drop("id")
        if attempts:
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(*attempts.values()))
        return out

    def rows(self) -> DataFrame:
        """All signed rows."""
        return self._rows(self.attempts())

    def totals(self, bucket: str = "hour") -> DataFrame:
        """(usage_date, bucket, model, measures) of what is live; groups that lost every message are gone."""
        name = F.col("hour") if bucket == "hour" else bucket_key(F.col("usage_date").cast("timestamp_ntz"), bucket)
        sums = self.rows().groupBy("usage_date", name.alias("bucket"), "model").agg(*[F.sum(c).cast("bigint").alias(c) for c in MEASURES])
        return sums.where("messages <> 0")

    def compact(self) -> int:
        """Fold what is committed now; returns the number of commits folded.  One driver compacts at a time."""
        attempts = self.attempts()  # listed once: a commit that comes meanwhile is not folded
        if not attempts:
            return 0
        sums = self._rows(attempts).groupBy("usage_date", "hour", "model").agg(*[F.sum(c).cast("bigint").alias(c) for c in MEASURES])
        out = sums.where(" or ".join(f"{c} <> 0" for c in MEASURES)).withColumn("id", F.lit(None).cast("string"))
        ids = self.spark.createDataFrame([(i,) for i in attempts], "id string")
        folded = self._folded_ids()
        if folded is not None:
            ids = ids.unionByName(folded)
        old = committed_versions(self.spark, self._folded)
        write_version(self.spark, out.unionByName(ids, allowMissingColumns=True), self._folded)
        for path in attempts.values():
            delete_path(self.spark, path)
        for n in old[:-1]:  # the last one may still be read
            delete_path(self.spark, f"{self._folded}/v={n}")
        return len(attempts)
