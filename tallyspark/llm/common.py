"""Helpers the corpus operators share: written tables, column picking, row streams.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``
(read from the session), which every executor can read, so a lost executor
never loses an intermediate result.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import apply_required_conf, scratch_dir
from tallyspark.sources.tables import delete_path

#: Rows of an Arrow batch handed to Python; texts can be long, so batches are short.
BATCH_ROWS = 1000
#: Text bytes worked on at once inside a Python task.
CHUNK_BYTES = 1 << 19


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on (idempotent)."""
    apply_required_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Plans that hold a table of fixed size as a constant would be kept in full text by the driver's listeners.
    spark.conf.set("spark.sql.maxPlanStringLength", "8000")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, scheme included."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables written by this driver, in order.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(build: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """``build()`` written, and the tables it wrote on the way removed."""
    first = len(_tables)
    out = written(build(), name)
    for path in _tables[first:-1]:
        delete_path(spark, path)
    del _tables[first:-1]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def in_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; gives freed memory back at the end, as Python workers stay beside the next stages' tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return task


def rowwise(x: np.ndarray, w: np.ndarray, bound: float = 16.0) -> np.ndarray:
    """``x @ w`` in float32, with each row's result a function of that row alone.

    A matrix product rounds a row differently with the rows beside it and the threads at work.
    Here both sides are rounded to whole numbers, small enough that all their products and sums
    are exact in float64, in any order.  ``x`` is clipped to ``+-bound``.  Float64 input is multiplied as it is.
    """
    if x.dtype == np.float64:
        return x @ w
    bits = 52 - np.log2(bound) - np.log2(max(float(np.abs(w).max(initial=0)), 1e-6)) - np.log2(x.shape[1])
    scale = 2.0 ** int(bits / 2)
    whole = np.rint(np.clip(x, -bound, bound).astype(np.float64) * scale) @ np.rint(w.astype(np.float64) * scale)
    return (whole / (scale * scale)).astype(np.float32)


# ---- Arrow batches -----------------------------------------------------------------------------


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column holding about ``limit`` bytes each (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and each row's offsets (nulls: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` in batches sorted by it, across batch edges."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and current != keys[start]:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield current, pa.Table.from_batches(held)


# ---- Connected components ----------------------------------------------------------------------


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the smallest node reached.

    Large-star / small-star rounds (Kiveris et al., 2014).  Each round is two
    aggregates and two equi-joins over a written edge table, so no neighbourhood
    is ever gathered: a node of very high degree is pre-aggregated before its
    shuffle, and as both sides of its joins are shuffled tables, adaptive
    execution can split them.
    """
    star = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = None
    while True:
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        # Large star: every larger neighbour of a node is linked to the node's smallest.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        # Small star: smaller neighbours and the node itself are linked to the smallest.
        small = large.join(low, "a")
        nxt = small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        star = written(nxt.distinct(), name)
        mark = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
