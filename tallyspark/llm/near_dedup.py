"""MinHash near-duplicate groups with fast similarity sketching.

Sketch (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, FOCS 2017):
a set is thrown into ``t`` bins in rounds.  In round ``i < t`` every element
gets a hashed bin and a hashed value ``i + u``; a bin keeps its least value;
rounds stop once all bins are filled.  From round ``t`` on, round ``t + b`` puts
every element into bin ``b``, so every coordinate fills after at most ``2t``
rounds.  Each coordinate of two sketches agrees with a probability equal to the
sets' Jaccard similarity, with concentration of Chernoff type, in
O(n + t log t) expected time.

Plan, all in Spark jobs:

1. one pass over the texts gives each document its set size, a 128-bit
   fingerprint of its shingle set and the band hashes of its sketch;
2. documents with equal sets are one class (copies are never expanded);
3. classes sharing a band hash are tied to the least class of that bucket and
   the ties' connected components are candidate clusters (linear in the band
   rows, however large a bucket is);
4. every cluster is verified on full shingle sets.  Its members are dealt into
   blocks of bounded size.  In a cluster of several blocks every member first
   meets one head, the member that most ties name; members that the head links
   are joined already.  Then every pair of blocks with a member that is still open
   is a tile of its own, so a crowd around one text costs about two rows a
   member and other huge clusters are many bounded tasks.  A tile compares what its
   links have not joined yet and returns a spanning forest, never all pairs;
5. components of the forests give the groups.

Missing a pair at exactly the threshold 0.8 needs all 64 bands of 8 to differ:
probability (1 - 0.8^8)^64 < 1e-5 for such a pair alone, less for closer ones.

Null, empty and blank texts have the empty set: linked with nothing and kept.
Rows without a doc_id link nothing, keep a null component and are kept.  Rows that
repeat a doc_id are one document, linked through any of its texts; one such row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import shingles as S
from tallyspark.llm.common import components, grouped, in_task, tune, written

BINS, ROWS = 512, 8
#: A block of a cluster holds about this many members, or this many text bytes.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 4 << 20
_U = np.uint64
_EMPTY = _U((1 << 64) - 1)

SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("cls", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
FOREST = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def sketches(sets: list[np.ndarray], t: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row of ``t`` values each."""
    out = np.full(len(sets) * t, _EMPTY, np.uint64)
    if not sets:
        return out.reshape(0, t)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)) * t, sizes)
    element = np.concatenate(sets)
    low = _U((1 << 52) - 1)
    for i in range(2 * t):
        x = S.mix(element + _U((0x9E3779B97F4A7C15 * (i + 1)) & ((1 << 64) - 1)))
        value = (x & low) | (_U(i) << _U(52))
        place = (x >> _U(52)).astype(np.int64) % t if i < t else i - t
        np.minimum.at(out, owner + place, value)
        if i < 3 or i % 8 == 0 or i >= t:
            open_ = (out.reshape(-1, t) == _EMPTY).any(axis=1)
            if not open_.any():
                break
            keep = open_[owner // t]
            owner, element = owner[keep], element[keep]
    return out.reshape(-1, t)


def band_hashes(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sketch.shape[1] // rows
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    parts = sketch.reshape(len(sketch), bands, rows)
    for r in range(rows):
        acc = S.mix(acc + parts[:, :, r])
    return acc.view(np.int64)


def _least_union(threshold: Fraction) -> int:
    """Smallest union two different sets that reach the threshold can have."""
    u = 1
    while Fraction(u - 1, u) < threshold:
        u += 1
    return u


def sketch_table(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    least = _least_union(threshold) - 1  # smaller sets are linked by equality alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            done = 0
            for sets in S.shingle_sets(texts, k):
                here = slice(done, done + len(sets))
                done += len(sets)
                usable = [i for i, s in enumerate(sets) if len(s) >= max(1, least)]
                hashed = band_hashes(sketches([sets[i] for i in usable]))
                bands: list = [None] * len(sets)
                for i, row in zip(usable, hashed, strict=True):
                    bands[i] = row
                part = texts.slice(here.start, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(here.start, len(sets)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pc.fill_null(pc.binary_length(part), 0).cast(pa.int64()),
                        pa.array([S.fingerprint(s) for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=SKETCH.names,
                )

    return docs.select("doc_id", "text").mapInArrow(in_task(run), SKETCH)


def link_forest(sets: list[np.ndarray], side: np.ndarray, threshold: Fraction) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``, found on the full sets.

    ``side``: 0/1; where both occur, only pairs across the sides are compared.
    A set is compared with those its links have not joined yet.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    mark = np.zeros(int(dense.max()) + 1, bool)
    label = np.arange(n)
    across = bool(side.min() != side.max())
    num, den = threshold.numerator, threshold.denominator
    out: list[tuple[int, int]] = []
    for x in range(n):
        todo = label != label[x]
        if across:
            todo &= side != side[x]
            if side[x]:
                break  # pairs across the sides were all seen from side 0
        else:
            todo[: x + 1] = False
        todo &= (np.minimum(sizes, sizes[x]) * den >= np.maximum(sizes, sizes[x]) * num)
        found = np.flatnonzero(todo)
        if not len(found):
            continue
        mine = dense[starts[x] : starts[x + 1]]
        mark[mine] = True
        lens = sizes[found]
        first = np.zeros(len(found), np.int64)
        np.cumsum(lens[:-1], out=first[1:])
        flat = np.arange(int(lens.sum())) + np.repeat(starts[found] - first, lens)
        inter = np.add.reduceat(mark[dense[flat]].astype(np.int64), first)
        mark[mine] = False
        linked = found[den * inter >= num * (sizes[x] + lens - inter)]
        for y in linked.tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _verify(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "tile"):
            names, reps = rows.column("cls").to_pylist(), rows.column("rep").to_pylist()
            side = rows.column("side").to_pylist()
            sets: dict[int, tuple[int, np.ndarray]] = {}
            at = 0
            for part in S.shingle_sets(rows.column("text"), k):
                for s in part:
                    # A repeated doc_id may bring another text: only the class's own set counts.
                    if S.fingerprint(s) == names[at]:
                        sets[reps[at]] = (side[at], s)
                    at += 1
            order = sorted(sets, key=lambda r: (sets[r][0], r))
            if len(order) < 2:
                continue
            forest = link_forest([sets[r][1] for r in order], np.array([sets[r][0] for r in order]), threshold)
            if forest:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([order[p[i]] for p in forest], pa.int64()) for i in (0, 1)], names=FOREST.names
                )

    return run


def near_duplicate_groups(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of the group)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(sketch_table(docs, k, threshold), "near-sketch")

    # Classes: equal sets.  Aggregated before the shuffle, so a group of many copies is one row a task.
    classes = (
        rows.where("cls is not null and doc_id is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.min("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    )
    classes = written(classes, "near-class")

    band = classes.where("bands is not null").select("rep", F.explode("bands").alias("bucket"))
    least = band.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last")
    ties = band.join(least.select("bucket", "head"), "bucket").where("rep <> head")
    ties = written(ties.select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), "near-tie")
    clusters = written(
        components(ties, "near-cc").select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "near-cluster"
    )
    links = verified_links(docs, classes, clusters, ties, k, threshold)

    # A doc_id that several rows carry joins the classes of all of them.
    twice = written(
        rows.where("cls is not null and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "near-twice",
    )
    if not twice.isEmpty():
        own = rows.join(twice, "doc_id", "left_semi").join(classes.select("cls", "rep"), "cls")
        links = links.union(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    groups = components(links, "near-cc")
    by_class = written(
        classes.select("cls", "rep")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("cls", F.coalesce("root", "rep").alias("component_id")),
        "near-group",
    )
    return rows.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _blocks(which: str) -> Column:
    """Blocks that the members for which ``which`` holds are dealt into."""
    n, size = F.count(F.expr(f"if({which}, 1, null)")), F.sum(F.expr(f"if({which}, n_bytes, 0)"))
    return F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_BYTES)).cast("int")


def _forest(texts: DataFrame, tiled: DataFrame, name: str, k: int, threshold: Fraction) -> DataFrame:
    """Spanning forest of the exact links inside each tile of ``tiled(rep, side, tile)``."""
    # A sort-merge join at every size: the tiles grow with the documents, so they are never broadcast.
    rows = written(tiled, f"near-{name}").join(texts.hint("merge"), "rep").select("tile", "side", "cls", "rep", "text")
    verify = in_task(_verify(k, threshold))
    return written(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(verify, FOREST), f"near-{name}-forest")


def _head_links(texts: DataFrame, members: DataFrame, ties: DataFrame, k: int, threshold: Fraction) -> DataFrame | None:
    """Exact links ``(head, member)`` in clusters of several blocks; the head is the member most ties name.

    A member is one row, a head one row a block of its cluster.
    """
    crowds = written(members.groupBy("cluster").agg(_blocks("true").alias("n_blocks")).where("n_blocks > 1"), "near-crowd")
    if crowds.isEmpty():
        return None
    named = ties.groupBy(F.col("b").alias("rep")).agg(F.count("*").alias("n")).join(members.select("rep", "cluster"), "rep")
    heads = named.join(crowds, "cluster").groupBy("cluster", "n_blocks")
    heads = written(heads.agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("head")), "near-head")
    crowd = members.join(heads, "cluster")
    block = F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    first = crowd.where("rep = head").select("rep", F.lit(0).alias("side"), "cluster", every.alias("block"))
    rest = crowd.where("rep <> head").select("rep", F.lit(1).alias("side"), "cluster", block.alias("block"))
    tiled = first.union(rest).select("rep", "side", F.xxhash64("cluster", "block").alias("tile"))
    return _forest(texts, tiled, "star", k, threshold)


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, ties: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Spanning forest ``(a, b)`` over class representatives of the exact links inside each cluster."""
    members = clusters.join(classes.select("cls", "rep", "n_bytes"), "rep")
    # The documents are shuffled once, for the texts of the members; heads and tiles then shuffle those alone.
    texts = members.select("rep", "cls").join(docs.hint("merge"), F.col("rep") == F.col("doc_id"))
    texts = written(texts.select("rep", "cls", "text"), "near-text")
    star = _head_links(texts, members, ties, k, threshold)
    if star is None:
        members = members.withColumn("joined", F.lit(False))
    else:
        joined = star.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("joined", F.lit(True))
        members = members.join(joined, "rep", "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    blocks = members.groupBy("cluster").agg(_blocks("not joined").alias("n_open"), _blocks("joined").alias("n_joined"))
    placed = members.join(written(blocks.where("n_open > 0"), "near-block"), "cluster")
    # Blocks of open members come first.  Tile (i, j), i <= j, compares block i with block j, (i, i) a block
    # with itself; two blocks of members that a head has joined have nothing left to find.
    last = F.when(F.col("joined"), F.col("n_open")).otherwise(F.col("n_open") + F.col("n_joined")) - 1
    h = F.xxhash64("cls")
    block = F.when(F.col("joined"), F.col("n_open") + F.pmod(h, F.col("n_joined"))).otherwise(F.pmod(h, F.col("n_open")))
    other = F.explode(F.sequence(F.lit(0), last))
    tiled = placed.select("rep", "cluster", block.cast("int").alias("block"), other.alias("other")).select(
        "rep",
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
    )
    links = _forest(texts, tiled, "tile", k, threshold)
    return links if star is None else links.union(star)


def deduplicate(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose doc_id is the least of its group."""
    groups = written(near_duplicate_groups(docs, k, threshold).select("doc_id", "component_id"), "near-row")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    twice = written(
        groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")),
        "near-twice",
    )
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti").union(again)
