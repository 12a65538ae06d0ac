"""Keyed table maintenance as DataFrame operations.

Tables here are immutable files; a change produces a new DataFrame that is
written as a new version (see ``sources.tables.write_version``), never over
the path being read.  All operations are joins on the key -- semi / anti /
full outer -- so they distribute like any other join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``existing`` (existing wins)."""
    return new.join(existing.select(key if isinstance(key, list) else [key]), key, "left_anti")


def keyed_union(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """existing + the rows of new with unseen keys."""
    return existing.unionByName(insert_or_ignore(existing, new, key))


def upsert(existing: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """Insert or replace by key: changed keys take the change row."""
    keys = key if isinstance(key, list) else [key]
    kept = existing.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.select(*existing.columns))


def last_per_key(changes: DataFrame, key: str | list[str]) -> DataFrame:
    """The last change of each key (by ``pos`` when given, else in input order): a later edit wins."""
    keys = key if isinstance(key, list) else [key]
    order = F.col("pos") if "pos" in changes.columns else F.monotonically_increasing_id()
    rest = [c for c in changes.columns if c not in keys]
    ordered = changes.withColumn("_order", order)
    last = ordered.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_order").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in changes.columns])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row in ``order``, without bringing all rows to one task.

    Rows are dealt into sorted ranges; a row's number is its place in its range
    after the counts of the ranges before (one row a range).
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")


def delete_keys(existing: DataFrame, keys_df: DataFrame, key: str | list[str]) -> DataFrame:
    """Remove rows whose key is listed; absent keys are no error."""
    return existing.join(keys_df.select(key if isinstance(key, list) else [key]), key, "left_anti")


def with_status(changes: DataFrame, existing: DataFrame, key: str, if_present: str, if_absent: str) -> DataFrame:
    """Tag each change with a status depending on whether its key exists."""
    present = existing.select(F.col(key).alias("_k")).distinct().withColumn("_present", F.lit(True))
    tagged = changes.join(present, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_present"), F.lit(if_present)).otherwise(F.lit(if_absent))
    return tagged.withColumn("status", status).drop("_k", "_present")
