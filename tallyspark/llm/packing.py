"""Order-preserving packing of token streams by dynamic programming.

Documents are dealt into ranges of doc_id, sorted, tokenised (each followed by
an end id) and laid end to end.  Window cuts are chosen among document ends,
sentence ends and, inside stretches without either, every sixteenth id, so as to
minimise padding plus penalties for cutting a document or truncating a sentence:

    cost(j) = penalty(j) + window - j + min { cost(i) + i : j - window <= i < j }

The minimum slides with j, so a monotone queue gives each transition in amortised
constant time.  A stream is solved in blocks of bounded length; what follows the
last cut of a block opens the next, so no window is short at a block's edge.
Only the last window of a range is filled up with padding.

Each range is one sorted shuffle partition, held one block (and one document) at
a time.  Null texts are empty documents (one end id); rows without a doc_id come
first; rows that repeat a doc_id are packed one after the other, told apart by
sequence_id and offset.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import tokens
from tallyspark.llm.common import in_task, tune

WINDOW, END_ID = 2048, 1
SENTENCE_PENALTY, TRUNCATION_PENALTY = 4, 16
#: Inside a longer stretch without a boundary, cuts are possible after so many ids each.
GRID = 16
#: Ids that are solved at once; a longer document makes a longer block.
BLOCK = 128 * WINDOW

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions a cut may fall on (ascending, after 0) and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    at = np.flatnonzero(penalty >= 0)
    edges = np.concatenate([[0], at, [len(ids)]])
    inner = np.maximum(0, (np.diff(edges) - 1) // GRID)
    nth = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    penalty[np.repeat(edges[:-1], inner) + (nth + 1) * GRID] = TRUNCATION_PENALTY
    at = np.flatnonzero(penalty[1:] >= 0) + 1
    return at, penalty[at]


def cuts(at: list[int], penalty: list[int], total: int, window: int, last: bool) -> list[int]:
    """Least-cost cut positions.  ``last``: the stream ends at ``total``; else the best cut near it ends the block."""
    if last and (not at or at[-1] != total):
        at, penalty = [*at, total], [*penalty, 0]
    n = len(at)
    f = [0] * (n + 1)  # cost + position, by candidate; 0 is the start
    back = [0] * n
    pos = [0, *at]
    queue = deque([0])
    for j in range(1, n + 1):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        back[j - 1] = i
        value = f[i] + penalty[j - 1] + window
        f[j] = value
        while queue and f[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    if last:
        j = n
    else:  # compare by cost: a later end holds more ids at the same number of windows
        j = min((k for k in range(1, n + 1) if pos[k] >= total - window), key=lambda k: f[k] - pos[k], default=n)
    out = []
    while j:
        out.append(pos[j])
        j = back[j - 1]
    return out[::-1]


class Packer:
    """One stream: takes documents in order, gives pieces."""

    def __init__(self, sentence_end: np.ndarray, first_id: int, window: int = WINDOW, block: int = BLOCK):
        self.sentence_end, self.window, self.block, self.next_id = sentence_end, window, block, first_id
        self.held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, ids before, document's ids, ids not placed
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.held.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)
        return self.solve(False) if self.size >= self.block else []

    def solve(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        flat = np.concatenate([h[3] for h in self.held])
        ends = np.cumsum([len(h[3]) for h in self.held])
        at, penalty = candidates(flat, ends, self.sentence_end)
        stops = cuts(at.tolist(), penalty.tolist(), len(flat), self.window, last)
        out, k, used, begun = [], 0, 0, 0
        for stop in stops:
            place = begun
            while place < stop:
                doc_id, before, total, ids = self.held[k]
                take = min(len(ids) - used, stop - place)
                out.append((doc_id, before + used, ids[used : used + take], total, self.next_id, place - begun))
                place, used = place + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            self.next_id += 1
            begun = stop
        rest = self.held[k:]
        if used:
            doc_id, before, total, ids = rest[0]
            rest[0] = (doc_id, before + used, total, ids[used:].copy())
        self.held, self.size = rest, len(flat) - begun
        return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True))
        cols[2] = [x.tobytes() for x in cols[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=PIECES.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer_path)
        # Sequence ids ascend with the ranges and are never shared between them.
        packer = Packer(bpe.sentence_ends(), TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py() or "")
                if pieces := packer.add(doc_id, np.append(ids, np.array(end_id, "<u4"))):
                    yield batch_of(pieces)
        if pieces := packer.solve(True):
            yield batch_of(pieces)

    return ranged.mapInArrow(in_task(run), PIECES)
