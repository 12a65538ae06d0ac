"""Ordering, top-k and rank positions.

``order_top`` is ``orderBy(...).limit(k)``, which Catalyst plans as
TakeOrderedAndProject: each partition keeps its own k best rows and only
those k x partitions rows meet in the final merge.  ``rank_index`` numbers
an already-limited result; its window has no partition key, so it is only
ever applied to a bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_index(top: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row of a bounded (top-k) result."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))).orderBy(name)
