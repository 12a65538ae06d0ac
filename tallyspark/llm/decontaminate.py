"""Benchmark decontamination by size-partitioned MinHash containment search (LSH Ensemble: Zhu et al., VLDB 2016).

Short test items are sought inside long documents.  Items are partitioned by the
size of their shingle set into classes ``(Q/2, Q]``, Q a power of two.  For a
class, every document is covered by windows of 2Q shingles that start every Q
shingles (a shorter document is one window), so the set an item is compared with
is never more than four times larger, whatever the document's length: containment
t of an item of more than Q/2 shingles then means a Jaccard similarity of at
least t / (5 - t) with its window.  Window signatures of all classes come from one
pass: minima over the blocks of the smallest class, doubled from class to class.
A window sharing any MinHash coordinate with an item makes (document, item) a
candidate; a containing pair is missed with probability (1 - t / (5 - t))^96,
below 1e-8 at t = 0.8.  An item scattered over a document meets several windows
with the same total chance.  Each candidate is verified on the exact shingle set of the whole document.

Documents never move: the items' signatures and sets go to the tasks in blocks of
at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text, one pass over the documents a block,
so nothing that is sent grows with either table.

Shingles are five words; a text of fewer words is one shingle, so such an item
matches only documents that consist of it.  Null and empty documents and items
match nothing.  Rows without doc_id or item_id are compared like others and keep
the null; rows and items that repeat an id are compared each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import shingles as S
from tallyspark.llm.common import in_task, text_chunks, tune

COORDS = 96
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
FILTER_BITS = 20
_A = np.random.default_rng(0xDEC0).integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)

MATCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_shingles", T.LongType()),
        T.StructField("shared_shingles", T.LongType()),
    ]
)


def _coordinate(x: np.ndarray, i: int) -> np.ndarray:
    """Values of the i-th hash; their minimum over a set is its i-th MinHash coordinate."""
    y = x * _A[i]
    return y ^ (y >> np.uint64(29))


class ItemBlock:
    """Signatures and exact sets of a bounded block of items, by size class."""

    def __init__(self, items: list[tuple[object, str]], k: int):
        column = pa.array([t for _, t in items], pa.string())
        sets = [s for part in S.shingle_sets(column, k) for s in part]
        self.items = [(items[i][0], s) for i, s in enumerate(sets) if len(s)]
        self.size_class = np.array([max(0, int(len(s) - 1).bit_length()) for _, s in self.items], np.int64)
        self.filters: dict[int, np.ndarray] = {}
        self.values: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in np.unique(self.size_class).tolist():
            members = np.flatnonzero(self.size_class == c)
            low = np.array([[_coordinate(self.items[m][1], i).min() for m in members] for i in range(COORDS)], np.uint64)
            flat = np.concatenate([self._key(row, i) for i, row in enumerate(low)])
            owner = np.tile(members, COORDS)
            order = np.argsort(flat, kind="stable")
            self.values[c] = (flat[order], owner[order])
            self.filters[c] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[c][(flat >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @staticmethod
    def _key(values: np.ndarray, i: int) -> np.ndarray:
        """Values of the i-th coordinate made distinct from those of the others."""
        return S.mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))

    def candidates(self, shingles: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs whose signatures meet; documents are ``shingles[at[d]:at[d+1]]`` in text order."""
        found: set[tuple[int, int]] = set()
        if not self.values or not len(shingles):
            return found
        classes = sorted(self.values)
        unit = 1 << classes[0]
        n = np.diff(at)
        blocks = -(-n // unit)
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(blocks, out=first[1:])
        doc = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(first[-1]) - first[doc]
        edges = at[doc] + nth * unit
        for i in range(COORDS):
            low = np.minimum.reduceat(_coordinate(shingles, i), edges)
            for c in range(classes[0], classes[-1] + 1):
                span = 1 << (c - classes[0])  # blocks in Q; the window is two of those
                if span < len(low):
                    paired = low.copy()
                    same = doc[:-span] == doc[span:]
                    paired[:-span][same] = np.minimum(low[:-span][same], low[span:][same])
                    low = paired
                if c in self.values:
                    at_start = nth % span == 0
                    keys, docs = self._key(low[at_start], i), doc[at_start]
                    hit = self.filters[c][(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    if hit.any():
                        values, owner = self.values[c]
                        keys, docs = keys[hit], docs[hit]
                        lo, hi = np.searchsorted(values, keys, "left"), np.searchsorted(values, keys, "right")
                        for d, x, y in zip(docs.tolist(), lo.tolist(), hi.tolist(), strict=True):
                            found.update((d, int(o)) for o in owner[x:y])
        return found


def matches(block: ItemBlock, column: pa.Array, threshold: float, k: int) -> Iterator[tuple[int, int, int]]:
    """(row, item of the block, shared shingles) of every containment, verified on whole texts."""
    for lo, hi in text_chunks(column):
        hashes, bounds = S.words(column.slice(lo, hi - lo))
        shingles, at = S.shingle_rows(hashes, bounds, k)
        sets: dict[int, np.ndarray] = {}
        for d, i in sorted(block.candidates(shingles, at)):
            if d not in sets:
                sets[d] = np.unique(shingles[at[d] : at[d + 1]])
            wanted = block.items[i][1]
            place = np.minimum(np.searchsorted(sets[d], wanted), len(sets[d]) - 1)
            shared = int((sets[d][place] == wanted).sum())
            if shared >= threshold * len(wanted) - 1e-9:
                yield lo + d, i, shared


def item_blocks(items: DataFrame, k: int) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null"
    )
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(blocks):
        here = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield ItemBlock(sorted(((r.item_id, r.text) for r in here.collect()), key=lambda r: (r[0] is not None, r)), k)


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, item_shingles, shared_shingles) where a document holds ``threshold`` of an item's shingles."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (batch.column(0)[d].as_py(), block.items[i][0], len(block.items[i][1]), shared)
                    for d, i, shared in matches(block, batch.column(1), threshold, k)
                ]
                if out:
                    cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=MATCH.names)

        return run

    parts = [docs.mapInArrow(in_task(search(block)), MATCH) for block in item_blocks(items, k)]
    return reduce(DataFrame.union, parts)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) whose whole text contains no item."""
    tune(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def drop(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for d, _, _ in matches(block, batch.column(at).cast(pa.string()), threshold, k):
                    clean[d] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in item_blocks(items, k):
        docs = docs.mapInArrow(in_task(drop(block)), docs.schema)
    return docs
