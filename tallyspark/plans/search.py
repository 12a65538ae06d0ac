"""Free-text search from an index of trigrams over the distinct searched texts.

The search filter (F-06) is a LIKE over five text columns of every fact.  Those columns hold
few distinct texts next to the facts, so the LIKE is answered on the texts and reaches the facts
as plain value sets and days, which prune partitions and files.

    values/    (field, value, id, usage_date): each text with every day it occurs on, an append log by batch
    postings/  (gram, field, id): the three-character parts of each folded text, sorted by gram

The literal runs between the needle's wildcards give grams; texts that hold all of them are candidates
and the search's own LIKE settles them, so the result is that of the filter.  Needles without a run of
three characters meet every text, still no fact.  ``id`` is a hash: texts that share one are candidates
together.  Null paths and branches count as empty, other nulls match nothing, as in the filter.

``refresh`` adds what a load brought and costs the batch and one pass over the stored texts; run it after
each load, as facts that were never shown to it are not found.  Texts of deleted facts stay and match no
fact.  Postings are written before their values, so a lost run is made good by the next.
One writer works on an index at a time.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import (
    UsageFilter,
    ascii_fold,
    fold,
    search_fields,
    search_predicate,
    text_matches,
)
from ..sources.tables import finished_paths, staged, staging

#: Matching texts up to which they are pushed to the facts as value sets; beyond, the facts meet the LIKE.
MAX_VALUES = 1000
#: Days up to which they are pushed to the facts as partitions (27 years).
MAX_DAYS = 10_000
#: Grams of a needle that are looked up; candidates meet the whole needle anyway.
MAX_GRAMS = 64

VALUES = "field string, value string, id bigint, usage_date date"
POSTINGS = "gram string, field string, id bigint"


def grams(text: Column) -> Column:
    """The distinct three-character parts of a text, none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))
    return F.when(F.length(text) >= 3, parts)


def needle_grams(search: str) -> list[str]:
    """The parts that every match of a needle holds."""
    runs = re.split("[%_]", fold(search))
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})[:MAX_GRAMS]


class SearchIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = finished_paths(self.spark, f"{self.base}/{name}")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, key: str) -> None:
        """Sorted by ``key`` over all files, so a look-up reads the row groups around its keys."""
        rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.base}/{name}/{uuid.uuid4().hex}")

    def refresh(self, usage: DataFrame) -> None:
        """Add the texts and days of ``usage``, as a rule the rows of a load."""
        with staging(self.spark):
            texts = F.array(*[F.struct(F.lit(name).alias("field"), c.alias("value")) for name, c in search_fields().items()])
            found = usage.select("usage_date", F.inline(texts)).where("value is not null").distinct()
            known = self._read("values", VALUES)
            new = staged(found.join(known, ["field", "value", "usage_date"], "left_anti"), "search-new")
            if not new.head(1):
                return
            new = new.withColumn("id", F.xxhash64("value"))
            fresh = new.select("field", "value", "id").distinct().join(known, ["field", "value"], "left_anti")
            parts = F.explode(grams(ascii_fold(F.col("value")))).alias("gram")
            self._write(fresh.select(parts, "field", "id"), "postings", "gram")
            self._write(new.select("field", "value", "id", "usage_date"), "values", "id")

    def find(self, search: str) -> DataFrame:
        """(field, value, id, usage_date) of every text that the search matches."""
        values, wanted = self._read("values", VALUES), needle_grams(search)
        if wanted:
            held = self._read("postings", POSTINGS).where(F.col("gram").isin(wanted))
            held = held.groupBy("field", "id").agg(F.countDistinct("gram").alias("grams"))
            values = values.join(held.where(F.col("grams") == len(wanted)), ["field", "id"], "left_semi")
        return values.where(text_matches(F.col("value"), search)).select("field", "value", "id", "usage_date")

    def narrowed(self, usage: DataFrame, f: UsageFilter) -> tuple[DataFrame, UsageFilter]:
        """The facts that match the filter's search, and what is left of the filter.

        Any report takes the two; ``usage`` is the stored facts that the index was refreshed with.
        """
        if not f.search:
            return usage, f
        with staging(self.spark):
            found = self.find(f.search)
            if f.from_day is not None:
                found = found.where(F.col("usage_date") >= F.lit(f.from_day))
            if f.to_day is not None:
                found = found.where(F.col("usage_date") < F.lit(f.to_day))
            found = staged(found, "search-found")
            days = [r.usage_date for r in found.select("usage_date").distinct().limit(MAX_DAYS + 1).collect()]
            texts = found.select("field", "value").distinct().limit(MAX_VALUES + 1).collect()
        if len(days) <= MAX_DAYS:
            usage = usage.where(F.col("usage_date").isin(days))
        matching = _value_sets(texts) if len(texts) <= MAX_VALUES else search_predicate(f.search)
        return usage.where(matching), dataclasses.replace(f, search=None)


def _value_sets(texts: list) -> Column:
    """One plain value set a field; an empty text stands for null too."""
    by_field: dict[str, list[str]] = {}
    for field, value in texts:
        by_field.setdefault(field, []).append(value)
    sets = [F.col(field).isin(values) for field, values in sorted(by_field.items())]
    sets += [F.col(field).isNull() for field, values in sorted(by_field.items()) if "" in values and field in ("cwd", "git_branch")]
    return functools.reduce(operator.or_, sets, F.lit(False))
