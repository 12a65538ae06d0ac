"""Bounded training samples of labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """Labels that may be learned from, one a document (the highest, if they differ)."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(~is_held_out(modulus, held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def class_shift(labels: DataFrame, label: str, modulus: int, held_out: int, sampled: list[int]) -> float:
    """What to add to the log-odds of a model trained on an even sample for the classes' true shares."""
    ones, rows = _known(labels, label, modulus, held_out).agg(F.sum("label"), F.count("*")).first()
    ones = ones or 0
    if not 0 < sum(sampled) < len(sampled):
        return 0.0
    return math.log(ones / (rows - ones)) - math.log(sum(sampled) / (len(sampled) - sum(sampled)))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, max_bytes: int
) -> list[tuple[int, str, int]]:
    """``(doc_id, text, label)`` of at most ``per_class`` labelled documents of either class, ordered by doc_id.

    Rows whose crc32(doc_id as text) mod ``modulus`` is ``held_out`` are never
    taken, nor labels other than 0 and 1.  The sample is the first documents by
    a hash of doc_id, so it does not depend on the tables' order; texts over
    ``max_bytes`` are left out of training (not of scoring).  Its size is
    bounded by ``2 * per_class * max_bytes``.
    """
    known = _known(labels, label, modulus, held_out)
    # Twice as many ids as needed: some labelled documents may be missing or too long.
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Broadcast: at most 4 * per_class rows of two integers.
    found = texts.join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= max_bytes)
    first = None
    for value in (0, 1):
        some = found.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class)
        first = some if first is None else first.union(some)
    rows = sorted((r.doc_id, r.text, r.label) for r in first.select("doc_id", "text", "label").collect())
    return rows


def is_held_out(modulus: int, held_out: int):
    """crc32(doc_id as text) mod ``modulus`` = ``held_out`` (false without a doc_id)."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == held_out, F.lit(False))
