"""K-d tree sharding: weighted median splits along the widest metadata dimension.

Points are groups of equal texts with metadata (text bytes, least language, source
and doc_id of the group) and a weight in bytes; a group heavier than
``GROUP_SHARE`` of a leaf is dealt into several points by a hash of doc_id.  A node
that is to become m leaves is split at the weighted quantile floor(m/2)/m of its
widest dimension, until every leaf is one shard, so leaves reach the target
bytes total/shards.

All nodes of a level are split together.  A quantile is found by refining
histograms: one aggregate over all points counts the weight in ``BINS`` cells of each
node's open interval, and the cell that holds the quantile is cut again until it
is light or a single value.  Coordinates are 62-bit: the dimension's place in its range, then a
hash of the group, so a value shared by a third of all points is split as finely
as any other.  The driver holds the tree and at most shards x BINS cells.

Null texts weigh as empty ones, null languages and sources sort first, rows
without a doc_id count as doc_id 0 for the order, repeated rows are separate
rows of one group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import tune, written

OVERHEAD = 16
BINS, GROUP_SHARE, CELL_SHARE = 2048, 0.1, 0.002
DIMS = ("d_bytes", "d_lang", "d_source", "d_doc")
_HIGH, _LOW = 30, 32
SLOT_BUCKETS = 64


@dataclass
class Node:
    leaves: int
    first: int
    dim: int | None = None
    cut: int | None = None  # coordinates up to and including it go left
    kids: list[Node] = field(default_factory=list)


def _prefix(text: Column) -> Column:
    """The first seven bytes of a text as a number that sorts as the text does."""
    head = F.rpad(F.hex(F.substring(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("double")


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, text_crc32, the text's 128-bit name (g1, g2) and metadata."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def column(name: str) -> Column:
        return F.col(name) if name in docs.columns else F.lit(None).cast("string")

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(OVERHEAD), text).alias("g2"),
        _prefix(column("lang")).alias("lang"),
        _prefix(column("source")).alias("source"),
    )


def _expression(node: Node, at_leaf) -> Column:
    """``node``'s tree as one expression over the coordinate columns."""
    if not node.kids:
        return at_leaf(node)
    left, right = (_expression(k, at_leaf) for k in node.kids)
    return F.when(F.col(f"c{node.dim}") <= F.lit(node.cut), left).otherwise(right)


def _leaves(node: Node) -> list[Node]:
    return [node] if not node.kids else [x for k in node.kids for x in _leaves(k)]


def coordinates(points: DataFrame) -> DataFrame:
    """Points with one 62-bit coordinate a dimension: place in the dimension's range, then a hash of the group."""
    ranges = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cols = []
    for i, d in enumerate(DIMS):
        lo, hi = ranges[f"lo_{d}"] or 0.0, ranges[f"hi_{d}"] or 0.0
        share = (F.col(d) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
        high = F.floor(share * ((1 << _HIGH) - 1)).cast("long")
        low = F.shiftrightunsigned(F.xxhash64("g1", "g2", "sub", F.lit(i)), 64 - _LOW)
        cols.append((F.shiftleft(high, _LOW) + low).alias(f"c{i}"))
    return points.select("g1", "g2", "sub", "weight", *cols)


def build_tree(points: DataFrame, shards: int) -> Node:
    """The k-d tree over ``coordinates(points)``; leaf ``first`` numbers are the shards."""
    root = Node(shards, 0)
    while open_ := [n for n in _leaves(root) if n.leaves > 1]:
        number = {id(n): i for i, n in enumerate(open_)}
        node = _expression(root, lambda n: F.lit(number.get(id(n), -1)))
        here = points.withColumn("node", node).where("node >= 0")
        spans = {
            r["node"]: r
            for r in here.groupBy("node")
            .agg(F.sum("weight").alias("w"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(len(DIMS)) for n, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        search = {}
        for i, n in enumerate(open_):
            n.kids = [Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)]
            if i not in spans:
                n.dim, n.cut = 0, -1  # no points: everything (nothing) goes right
                continue
            r = spans[i]
            # Widest by the place in the range; the hash below it only settles ties.
            n.dim = max(range(len(DIMS)), key=lambda d: ((r[f"hi{d}"] >> _LOW) - (r[f"lo{d}"] >> _LOW), -d))
            search[i] = {"lo": r[f"lo{n.dim}"], "hi": r[f"hi{n.dim}"], "before": 0, "want": r["w"] * (n.leaves // 2) / n.leaves, "fine": r["w"] / n.leaves * CELL_SHARE}
        _find_cuts(here, open_, search)
    return root


def _find_cuts(here: DataFrame, open_: list[Node], search: dict[int, dict]) -> None:
    while search:
        cell = None
        for i, s in search.items():
            step = s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
            c = f"c{open_[i].dim}"
            inside = (F.col("node") == i) & F.col(c).between(s["lo"], s["hi"])
            here_cell = F.expr(f"cast(({c} - {s['lo']}L) div {step}L as int)")
            cell = F.when(inside, here_cell) if cell is None else cell.when(inside, here_cell)
        counted = here.select("node", cell.alias("cell"), "weight").where("cell is not null")
        cells: dict[int, list[tuple[int, int]]] = {}
        for r in counted.groupBy("node", "cell").agg(F.sum("weight").alias("w")).collect():
            cells.setdefault(r["node"], []).append((r["cell"], r["w"]))
        for i in list(search):
            s, n = search[i], open_[i]
            total = s["before"]
            for cell, w in sorted(cells.get(i, [])):
                lo = s["lo"] + cell * s["step"]
                hi = min(s["hi"], lo + s["step"] - 1)
                if total + w >= s["want"]:
                    if lo == hi or w <= s["fine"]:
                        # The nearer edge of the last cell.
                        n.cut = hi if total + w - s["want"] <= s["want"] - total else lo - 1
                        del search[i]
                    else:
                        s.update(lo=lo, hi=hi, before=total)
                    break
                total += w
            else:
                n.cut = s["hi"]
                del search[i]


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes, slots gapless from 0 in each."""
    tune(docs.sparkSession)
    rows = written(measured(docs), "shard-rows")
    # Repeated rows are told apart by their place in the table.
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    rows = rows.select("*", place.alias("place"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = max(1.0, total / shards * GROUP_SHARE)
    # Groups over the bound: at most shards / GROUP_SHARE of them, whatever the input.
    heavy = (
        rows.groupBy("g1", "g2")
        .agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        .where((F.col("w") > most) & (F.col("n") > 1))
        .select("g1", "g2", F.least(F.col("n"), F.ceil(F.col("w") / F.lit(most / 2))).alias("parts"))
    )
    dealt = rows.join(F.broadcast(heavy), ["g1", "g2"], "left").withColumn(
        "sub", F.coalesce(F.pmod(F.col("place"), F.col("parts")), F.lit(0)).cast("long")
    )
    points = dealt.groupBy("g1", "g2", "sub").agg(
        F.sum("size").alias("weight"),
        F.log2(F.max("size")).alias("d_bytes"),
        F.min("lang").alias("d_lang"),
        F.min("source").alias("d_source"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_doc"),
    )
    points = written(points, "shard-points")
    placed = written(coordinates(points), "shard-coords")
    tree = build_tree(placed, shards)
    leaf = written(placed.select("g1", "g2", "sub", _expression(tree, lambda n: F.lit(n.first)).alias("shard")), "shard-leaf")
    # A group is light or dealt into light parts, so no key of this join is heavy.
    sharded = dealt.join(leaf, ["g1", "g2", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", "place", F.pmod(F.xxhash64("place"), F.lit(SLOT_BUCKETS)).alias("bucket")
    )
    sharded = written(sharded, "shard-placed")
    # Slots: rows are numbered inside SLOT_BUCKETS parts of a shard, after the counts of the parts before.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "place")
    return sharded.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(inside) - 1).alias("slot")
    )
