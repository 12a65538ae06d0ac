"""Grouped measures shared by the reports.

The reports themselves build one fine aggregate each (``reports.fine``) and
roll up from it; the helpers here are the reusable pieces: bucketing,
the (bucket, model) series aggregate, the project roll-up and the distinct
option lists.  Every aggregate has a partial (map-side) phase, so a hot key
-- one session, model or project holding a large share of the rows -- is
combined inside each map task before the shuffle.  Distinct session counts
stay ``countDistinct`` (they cannot be rolled up from finer groups);
Catalyst plans them as a two-level aggregate keyed on the session id, which
is also combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket_key
from ..schemas import SYNTHETIC_MODEL, TOKEN_COLUMNS
from .rates import sum_tokens


def with_bucket(u: DataFrame, bucket: str) -> DataFrame:
    return u.withColumn("bucket", bucket_key(F.col("ts"), bucket)).filter(F.col("bucket").isNotNull())


def time_series_by_model(u: DataFrame, bucket: str) -> DataFrame:
    return with_bucket(u, bucket).groupBy("bucket", "model").agg(*sum_tokens())


def project_rollup(priced_pm: DataFrame) -> DataFrame:
    """Second-stage roll-up of priced (project, model) rows to projects."""
    return priced_pm.groupBy("project_key").agg(
        F.array_sort(F.collect_set("model")).alias("models"),
        *[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLUMNS],
        F.sum("messages").cast("bigint").alias("messages"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def distinct_projects(u: DataFrame) -> DataFrame:
    """All project keys, synthetic rows included (no filter is applied)."""
    return u.select(F.col("project_key")).distinct()


def distinct_models(u: DataFrame) -> DataFrame:
    return u.filter(F.col("model") != F.lit(SYNTHETIC_MODEL)).select("model").distinct()


