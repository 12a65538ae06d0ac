"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components are quantised to integers.  The index, a written table, deals the
vectors into blocks of bounded size and has a row for each segment of a block: its
postings (vector, dimension, value) of equal quantised impact, the bit length of
``|value|``.  Queries are taken in blocks too, and every pair of blocks is a
task of its own that meets the segments in order of falling impact.

Segments are processed by descending impact: each adds its part of the scores.
What is still unread of a vector bounds the rest of its score by
Cauchy-Schwarz, so every score lies in ``acc +- |q| |rest|``.  A query stops only on
proof: when the vectors whose upper bound reaches the k-th best lower bound are
few, those possible members are rescored with their whole vectors and the rest are proven
outside.  Without such a proof all segments are read.  Scores are
exact integers (float32 only where all sums stay below 2^24, else float64).

Vectors that are null or hold null or non-finite components take no part, nor do
rows without a vec_id; a shorter vector's missing components count as 0.  A query
is never its own neighbour: rows with its vec_id are left out.  Ties go to
the smaller vec_id.  Every row counts: a repeated vec_id is as many candidates as it
has rows, and as a query its rows share the k places of the one query_id.  Equal
rows beyond the k-th could fill no further place and are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.llm.common import grouped, in_task, tune, written

SCALE = 256
BLOCK, QUERY_BLOCK = 8192, 512
#: Rescoring starts when at most this share of a block is still possible and the unread mass is small.
POSSIBLE_SHARE, REST_SHARE = 0.02, 0.15

HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components x as floor(256 * x), x as double; only vectors that are whole and finite."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))
    )


def numbered(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, nth) of quantised rows, equal ones numbered from 1 to at most k."""
    # Equal rows are counted before the shuffle, so a row that fills a third of the table is no hot key.
    n = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    return n.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("n")))).alias("nth"))


def _dealt(parts: int) -> Column:
    """One of ``parts`` by the whole row: neither a repeated vec_id nor a repeated row lands in one part."""
    return F.pmod(F.xxhash64("vec_id", "v", "nth"), F.lit(parts)).cast("int")


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    column = rows.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == sizes.max() == width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


class ImpactIndex:
    """A block of vectors as posting segments by descending quantised impact: (impact, vector, dimension, value)."""

    def __init__(self, ids: np.ndarray, segments: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int):
        self.ids, self.segments = ids, segments
        self.vectors = np.zeros((len(ids), width), np.int64)  # for rescoring
        for _, vector, dim, value in segments:
            self.vectors[vector, dim] = value

    @staticmethod
    def segments_of(vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        level = np.frexp(np.abs(vectors).astype(np.float64))[1]
        out = []
        for impact in sorted(np.unique(level[vectors != 0]).tolist(), reverse=True):
            vector, dim = np.nonzero((level == impact) & (vectors != 0))
            out.append((impact, vector, dim, vectors[vector, dim]))
        return out

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """The k best (query_id, vec_id, score) of the block for each query."""
        n = len(self.ids)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        longest = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1).max(initial=0))
        kind = np.float32 if norms.max(initial=0) * longest < 1 << 23 else np.float64
        q = queries.astype(kind)
        acc = np.zeros((len(q), n), kind)
        acc[query_ids[:, None] == self.ids[None, :]] = -np.inf  # rows of the query's own id take no place
        rest = (self.vectors.astype(np.float64) ** 2).sum(1)
        whole = rest.sum()
        active = np.arange(len(q))
        out: list[tuple[int, int, int]] = []
        need = min(n, k)
        for i, (_, vector, dim, value) in enumerate(self.segments):
            part = np.zeros(self.vectors.shape, kind)
            part[vector, dim] = value
            acc += q[active] @ part.T
            np.subtract.at(rest, vector, value.astype(np.float64) ** 2)
            if i + 1 == len(self.segments) or rest.sum() > REST_SHARE * whole:
                continue
            slack = norms[active][:, None] * np.sqrt(np.maximum(rest, 0))[None, :] + 0.5
            reach = np.partition(acc - slack, n - need, axis=1)[:, n - need]
            possible = acc + slack >= reach[:, None]
            proven = possible.sum(1) <= max(need, POSSIBLE_SHARE * n)
            for a in np.flatnonzero(proven):
                out += self._best(query_ids[active[a]], queries[active[a]], np.flatnonzero(possible[a]), k)
            active, acc = active[~proven], acc[~proven]
            if not len(active):
                return out
        for a, x in enumerate(active):
            row = acc[a]
            close = np.flatnonzero(row >= np.partition(row, n - need)[n - need])
            out += self._best(query_ids[x], queries[x], close, k)
        return out

    def _best(self, query_id: int, query: np.ndarray, members: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Exact integer scores of the possible members, best first."""
        members = members[self.ids[members] != query_id]
        score = self.vectors[members] @ query
        order = np.lexsort((self.ids[members], -score))[:k]
        return [(int(query_id), int(self.ids[members[o]]), int(score[o])) for o in order]


INDEX = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("impact", T.IntegerType()),  # HEAD: the block's vec_ids, in ``value``
        *[T.StructField(c, T.BinaryType()) for c in ("vector", "dim", "value")],
    ]
)
HEAD = 1 << 20


def build_index(vectors: DataFrame, width: int, blocks: int) -> DataFrame:
    """INDEX rows of ``vectors(vec_id, v, nth)``: for each block its vec_ids, then its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in grouped(batches, "block"):
            found = [(HEAD, b"", b"", rows.column("vec_id").to_numpy().astype("<i8").tobytes())]
            for impact, vector, dim, value in ImpactIndex.segments_of(_matrix(rows, width)):
                found.append((impact, vector.astype("<u4").tobytes(), dim.astype("<u4").tobytes(), value.astype("<i8").tobytes()))
            impacts, *data = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(found), pa.int32()), pa.array(impacts, pa.int32()), *(pa.array(d, pa.binary()) for d in data)],
                names=INDEX.names,
            )

    dealt = vectors.select(_dealt(blocks).alias("block"), "vec_id", "v")
    return written(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(in_task(run), INDEX), "topk-index")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query with the other rows."""
    tune(vectors.sparkSession)
    rows = written(numbered(quantised(vectors), k), "topk-vectors")
    asked = written(numbered(quantised(queries), k), "topk-queries")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, also = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, also, 1)
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    index = build_index(rows, width, blocks)

    def tile(block, query_block):
        return (block * F.lit(query_blocks).cast("long") + query_block).alias("tile")

    nothing = [F.lit(None).cast("binary").alias(c) for c in ("vector", "dim", "value")]
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    stored = index.select("*", every.alias("q")).select(
        tile(F.col("block"), F.col("q")), F.lit(1).alias("side"), "impact", "vector", "dim", "value",
        F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    wanted = asked.select("vec_id", "v", _dealt(query_blocks).alias("q"), every.alias("block")).select(
        tile(F.col("block"), F.col("q")), F.lit(0).alias("side"), F.lit(0).alias("impact"), *nothing, "vec_id", "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "tile"):
            side = rows.column("side").to_numpy()
            block, mine = rows.filter(pa.array(side == 1)), rows.filter(pa.array(side == 0))
            if not block.num_rows or not mine.num_rows:
                continue
            ids, segments = np.zeros(0, np.int64), []
            for impact, vector, dim, value in zip(*(block.column(c).to_pylist() for c in ("impact", "vector", "dim", "value")), strict=True):
                if impact == HEAD:
                    ids = np.frombuffer(value, "<i8")
                else:
                    segments.append((impact, *(np.frombuffer(x, "<u4").astype(np.int64) for x in (vector, dim)), np.frombuffer(value, "<i8")))
            found = ImpactIndex(ids, segments, width).top(mine.column("vec_id").to_numpy(), _matrix(mine, width), k)
            if found:
                cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=HITS.names)

    order = ["tile", "side", F.desc("impact")]
    hits = stored.unionByName(wanted).repartition("tile").sortWithinPartitions(*order).mapInArrow(in_task(run), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
