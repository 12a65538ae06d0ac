"""Provider price feed: snapshot files and feeds derived from tables.

A provider is any DataFrame with columns (pos, id, prompt, completion,
input_cache_read, input_cache_write), ``pos`` being the entry's position in
the feed (later entries win when two ids normalise to the same model).  The
network fetch itself is not part of this library: a snapshot of the
provider's JSON response (``{"data": [{"id", "pricing": {...}}]}``) is read
from storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEED

FEED_COLUMNS = ["pos", "id", "prompt", "completion", "input_cache_read", "input_cache_write"]


def read_feed_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed entry of a JSON snapshot (one document per file)."""
    doc = spark.read.schema(FEED).option("multiLine", True).json(path)
    entries = doc.select(F.posexplode("data").alias("pos", "m"))
    return entries.select(
        F.col("pos").cast("bigint").alias("pos"),
        F.col("m.id").alias("id"),
        F.col("m.pricing.prompt").alias("prompt"),
        F.col("m.pricing.completion").alias("completion"),
        F.col("m.pricing.input_cache_read").alias("input_cache_read"),
        F.col("m.pricing.input_cache_write").alias("input_cache_write"),
    )
