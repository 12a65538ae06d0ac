"""Exact hard negatives by cover trees over norm-augmented candidates.

For an anchor row, its positives are the other rows of its label with the highest inner
products; the hard negatives of a positive are the rows of other labels with the highest
products in the window from a share of the positive's score up to that score.

Candidates get one more component, ``sqrt(M^2 - |x|^2)``, so that all have the norm M of the
longest.  For an anchor q, extended by 0, the inner product is then a function of the
distance, ``(|q|^2 + M^2 - d^2) / 2``, and whatever lies within r of a centre c has a product in
``q.c +- |q| r`` and, by the triangle inequality, at most ``q.c + d r - r^2 / 2``.

* Candidates are dealt into blocks by label and nearest pivot, cells too large for a block by
  row.  The pivots are spread over a bounded sample of ``SAMPLE`` rows; every row is indexed.
* Each block has a cover tree: a node's set is covered by centres picked farthest first until
  all lie within 1/``BASE`` of the node's radius, so centres of a level keep that distance from each
  other and a node's own centre is its first child's.  Nodes keep their true covering radius.
* A search goes down level by level, drops a node for every window that its bounds miss,
  takes the leaves by falling bound, skips those that cannot reach the k-th best any more,
  and verifies the others with exact integer products.

Vectors are integers, ``floor(256 * x)``.  Rows without vec_id, label or vector, or with a null or
non-finite component, take no part; missing components of shorter vectors are 0.  Every row
counts, repeated ids and rows too: the others of a row are all rows but itself, and each row of
an anchor's id asks for itself.  Ties go to the smaller vec_id.  Negative positives have an
empty window.  Other columns are not read; empty tables give no rows.  Blocks hold at most some
``BLOCK`` rows; anchors meet a block in batches, and the index is shuffled once a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.llm.common import grouped, in_task, tune, written

SCALE = 256
#: Rows of a block; groups of labels; pivots at most and the sample they are picked from.
BLOCK, LABELS, PIVOTS, SAMPLE = 8192, 64, 256, 4096
#: Ratio of the radii of two levels; rows below which a node is a leaf.
BASE, LEAF = 1.3, 32
LOWEST = -(1 << 62)


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, written."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)))
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"),
        ),
        "mining-rows",
    )


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def augmented(points: np.ndarray, longest: float) -> np.ndarray:
    """The points, all of norm ``sqrt(longest)`` by one more component."""
    x = points.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def farthest_first(x: np.ndarray, within: float, most: int, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres, each point's centre and distance, with all points ``within`` of theirs; None if ``most`` centres do not do."""
    centres, owner, near = [first], np.zeros(len(x), np.int64), _distances(x, x[first])
    while near.max() > within:
        if len(centres) == most:
            return None
        far = int(near.argmax())
        d = _distances(x, x[far])
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
        centres.append(far)
    return centres, owner, near


class CoverTree:
    """Nodes by level; each is a range of the points, which are put into the tree's order."""

    def __init__(self, levels: list[np.ndarray], centres: np.ndarray):
        self.levels, self.centres = levels, centres

    #: A node: first and last point, radius, first child and number of children in the next level.
    NODE = np.dtype([("lo", "<i8"), ("hi", "<i8"), ("radius", "<f8"), ("child", "<i8"), ("children", "<i8")])

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Order of the points, nodes of each level, their centres (numbers in that order)."""
        order = np.arange(len(x))
        radius = float(_distances(x, x[0]).max())
        sets = [(0, len(x), 0, radius)]  # range, centre's place in it, radius
        levels, centres = [], []
        while sets:
            nodes, heads, below = np.zeros(len(sets), cls.NODE), [], []
            for i, (lo, hi, centre, r) in enumerate(sets):
                heads.append(order[lo + centre])
                nodes[i] = (lo, hi, r, len(below), 0)
                if hi - lo <= LEAF or r == 0:
                    continue
                mine = order[lo:hi]
                cover = farthest_first(x[mine], r / BASE, max(2, (hi - lo) // 4), centre)
                if cover is None:  # nothing that this radius would tell apart
                    continue
                picked, owner, near = cover
                by = np.argsort(owner, kind="stable")
                order[lo:hi] = mine[by]
                edges = np.searchsorted(owner[by], np.arange(len(picked) + 1))
                for j, p in enumerate(picked):
                    a, b = edges[j], edges[j + 1]
                    below.append((lo + a, lo + b, int(np.flatnonzero(by[a:b] == p)[0]), float(near[by[a:b]].max())))
                nodes[i]["children"] = len(picked)
            levels.append(nodes)
            centres.append(np.array(heads))
            sets = below
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        return order, levels, [place[c] for c in centres]


class Block:
    """A block's rows in tree order and the search over them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, tree: CoverTree, longest: float):
        self.rows, self.ids, self.labels, self.points, self.tree, self.longest = rows, ids, labels, points, tree, longest
        # Order of ties: by vec_id.
        self.rank = np.empty(len(ids), np.int64)
        self.rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        self.by_rank = np.argsort(self.rank)

    def _bounds(self, q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and highest products of each query with what the nodes cover."""
        product = q @ self.points[centres].T.astype(np.float64)
        square = (q * q).sum(1)[:, None]
        reach = np.sqrt(square) * radius
        distance = np.sqrt(np.maximum(square + self.longest - 2 * product, 0))
        # Beyond r only: a node around the query bounds nothing that way.
        turn = np.where(distance > radius, distance * radius - radius * radius / 2, np.inf)
        slack = 1 + 1e-9 * (np.abs(product) + reach)
        return product - reach - slack, product + np.minimum(reach, turn) + slack

    def search(
        self, own: np.ndarray, label: np.ndarray, queries: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each item (a query's number, a window): item, place of the row, score."""
        q = queries.astype(np.float64)
        live = np.ones((len(item), 1), bool)
        leaves: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        at = np.array([0])
        for depth, (level, centres) in enumerate(zip(self.tree.levels, self.tree.centres, strict=True)):
            nodes = level[at]
            least, most = self._bounds(q, centres[at], nodes["radius"])
            live &= (most[item] >= lo[:, None]) & (least[item] <= hi[:, None])
            for i in np.flatnonzero((nodes["children"] == 0) & live.any(0)):
                leaves.append((int(nodes["lo"][i]), int(nodes["hi"][i]), live[:, i], np.minimum(most[item, i], hi)))
            inner = np.flatnonzero((nodes["children"] > 0) & live.any(0))
            if depth + 1 == len(self.tree.levels) or not len(inner):
                break
            n = nodes["children"][inner]
            at = np.repeat(nodes["child"][inner] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            live = live[:, np.repeat(inner, n)]
        best_score = np.full((len(item), k), LOWEST)
        best_rank = np.full((len(item), k), len(self.ids))
        for a, b, wanted, reach in sorted(leaves, key=lambda leaf: -leaf[3][leaf[2]].max()):
            i = np.flatnonzero(wanted & (reach >= best_score[:, -1]))
            if not len(i):
                continue
            asked, back = np.unique(item[i], return_inverse=True)
            score = (queries[asked] @ self.points[a:b].T)[back]
            right = (self.labels[a:b] == label[item[i], None]) == same
            fits = right & (self.rows[a:b] != own[item[i], None]) & (score >= lo[i, None]) & (score <= hi[i, None])
            score = np.hstack([best_score[i], np.where(fits, score, LOWEST)])
            rank = np.hstack([best_rank[i], np.where(fits, self.rank[a:b], len(self.ids))])
            top = np.lexsort((rank, -score), axis=1)[:, :k] if b - a <= 4 * LEAF else self._top(score, rank, k)
            best_score[i], best_rank[i] = np.take_along_axis(score, top, 1), np.take_along_axis(rank, top, 1)
        found, nth = np.nonzero(best_score > LOWEST)
        return found, self.by_rank[best_rank[found, nth]], best_score[found, nth]

    @staticmethod
    def _top(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of each row: only what reaches the k-th score is ordered."""
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        out = np.empty((len(score), k), np.int64)
        for i in range(len(score)):
            close = np.flatnonzero(score[i] >= cut[i])
            out[i] = close[np.lexsort((rank[i, close], -score[i, close]))[:k]]
        return out


# ---- Spark ------------------------------------------------------------------------------------

INDEX = T.StructType(
    [T.StructField("block", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("rows", "ids", "labels", "points", "sizes", "nodes", "centres")]]
)


def build_index(rows: DataFrame, width: int, longest: float, n: int) -> tuple[DataFrame, dict[int, list[int]], int]:
    """A row a block, written; the blocks of each group of labels; the number of blocks."""
    spark = rows.sparkSession
    sample = rows.select("v").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
    x = augmented(matrix(sample.column("v"), width), longest)
    pivots = x[_spread(x, min(PIVOTS, -(-n // BLOCK), len(x)))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = augmented(matrix(batch.column("v"), width), longest)
            cell = (p @ pivots.T).argmax(1) if len(p) else np.zeros(0, np.int64)  # equal norms: the nearest
            yield batch.append_column("cell", pa.array(cell, pa.int64()))

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])
    dealt = rows.mapInArrow(in_task(assign), schema).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABELS)))
    dealt = written(dealt, "mining-cells")
    first, blocks, total = [], {}, 0
    for r in dealt.groupBy("bucket", "cell").count().collect():  # LABELS x PIVOTS at most
        parts = -(-r["count"] // BLOCK)
        first.append((r.bucket, r.cell, total, parts))
        blocks.setdefault(r.bucket, []).extend(range(total, total + parts))
        total += parts
    cells = spark.createDataFrame(first, "bucket long, cell long, first int, parts int")
    dealt = dealt.join(F.broadcast(cells), ["bucket", "cell"])
    block = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("block")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mine in grouped(batches, "block"):
            points = matrix(mine.column("v"), width)
            order, levels, centres = CoverTree.build(augmented(points, longest))
            data = [mine.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("row", "vec_id", "label")]
            data += [points[order].astype("<i8").tobytes(), np.array([len(x) for x in levels], "<i8").tobytes()]
            data += [np.concatenate(levels).tobytes(), np.concatenate(centres).astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], names=INDEX.names)

    index = dealt.select(block, "row", "vec_id", "label", "v").repartition("block").sortWithinPartitions("block")
    return written(index.mapInArrow(in_task(build), INDEX), "mining-index"), blocks, total


def _spread(x: np.ndarray, n: int) -> list[int]:
    """The first ``n`` points of a farthest-first order."""
    picked, near = [0], _distances(x, x[0])
    while len(picked) < n:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[picked[-1]]))
    return picked


def _block(row: dict[str, bytes], width: int, longest: float) -> Block:
    rows, ids, labels, points, sizes, centres = (np.frombuffer(row[c], "<i8") for c in ("rows", "ids", "labels", "points", "sizes", "centres"))
    edges = np.cumsum(sizes)[:-1]
    tree = CoverTree(np.split(np.frombuffer(row["nodes"], CoverTree.NODE), edges), np.split(centres, edges))
    return Block(rows, ids, labels, points.reshape(-1, width), tree, longest)


HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "nth", "vec_id", "score")])


def _searched(index: DataFrame, asked: DataFrame, width: int, longest: float, same: bool, k: int) -> DataFrame:
    """HITS of ``asked(block, row, label, v, windows)`` in their blocks; windows are (nth, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            numbers, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            for a in np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (side[1:] != side[:-1])) if len(numbers) else []):
                b = a + int(np.argmin(np.append((numbers[a:] == numbers[a]) & (side[a:] == side[a]), False)))
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    number, block = numbers[a], _block(part.to_pylist()[0], width, longest)
                    continue
                assert number == numbers[a]
                windows = part.column("windows")
                item = np.repeat(np.arange(len(part)), pc.list_value_length(windows).to_numpy(zero_copy_only=False))
                nth, lo, hi = (windows.flatten().field(i).to_numpy() for i in range(3))
                own = part.column("row").to_numpy()
                found, place, score = block.search(own, part.column("label").to_numpy(), matrix(part.column("v"), width), item, lo, hi, same, k)
                cols = [own[item[found]], nth[found], block.ids[place], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=HITS.names)

    stored = index.withColumn("side", F.lit(0))
    both = stored.unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(in_task(run), HITS)


def _best(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``anchors`` is a condition on them.
    """
    tune(rows.sparkSession)
    every = usable(rows)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, longest = every.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return rows.sparkSession.createDataFrame([], result)
    width = max(width, 1)
    index, blocks, total = build_index(every, width, longest, n)
    asked = written(every.where(anchors), "mining-anchors")
    everywhere = F.array(F.struct(F.lit(1).cast("long").alias("nth"), F.lit(LOWEST + 1).alias("lo"), F.lit(-LOWEST).alias("hi")))
    mine = rows.sparkSession.createDataFrame([(b, x) for b, found in blocks.items() for x in found], "bucket long, block int")
    near = asked.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABELS))).join(mine, "bucket")
    near = near.select("block", "row", "label", "v", everywhere.alias("windows"))
    found = _best(_searched(index, near, width, longest, True, positives), ["row"], positives)
    found = written(found.select("row", F.col("rank").cast("long").alias("nth"), "vec_id", "score"), "mining-positives")
    # Windows of whole scores; those of negative positives are empty.
    least = F.expr(f"(score * {least_percent} + 99) div 100")
    windows = found.where("score >= 0").groupBy("row").agg(F.collect_list(F.struct("nth", least.alias("lo"), F.col("score").alias("hi"))).alias("windows"))
    far = asked.join(windows, "row").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    hits = _best(_searched(index, far.select("block", "row", "label", "v", "windows"), width, longest, False, negatives), ["row", "nth"], negatives)
    hits = hits.select("row", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    return hits.join(named, ["row", "nth"]).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
