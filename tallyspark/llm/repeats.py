"""Bytes covered by strings of 100 bytes that also start earlier, by deep-shallow suffix sorting.

Texts are UTF-8 bytes; a string starts earlier in a smaller doc_id or, in one document, at a
smaller offset, and never crosses documents.  A byte goes if any 100-byte string over it
has an earlier start anywhere in the input, whether that one stays or not.

Suffixes matter to a depth of 100 only, and only where they can have an equal.  Of the
69 grams of 32 bytes in a string the one with the least hash (the leftmost of equal ones)
is its *anchor*: a function of the string alone, so equal strings have equal anchors at
equal places.  Strings that follow each other mostly share theirs, so a text has one
*segment* (the strings of one anchor, laid end to end) in some 35 bytes.

1. equal texts are one: the least doc_id stands for them, in all others every byte goes;
2. anchors are shuffled as three numbers each; those whose hash comes once are dropped;
3. the segments of the others meet by anchor.  Equal segments follow each other in
   sorted order: all strings of the second and later ones repeat;
4. what is left, different segments of one anchor, is suffix-sorted: a multikey quicksort
   that takes eight bytes as a character orders all open sets at once to a shallow depth;
   sets that still share their prefix then go through blind tries, which hold but the
   first differing bit of a branch and compare a whole string once (pairs are compared
   directly; sets too large for a trie stay with the quicksort);
5. of equal strings all but the earliest mark their bytes.  Marks, not texts, travel back.

Hot anchors and segments are thinned before they are shuffled: of the texts a task works on at
once one row of an anchor and the earliest of equal segments go by the anchor; the
others, whose fate is known, are dealt out evenly.

Texts move once, into a table bucketed by a hash of the text, to which anchors and
marks are joined without moving it again.  An anchor of more than ``HOT`` different
segments is not gathered: its strings are dealt out one by one, by the string itself,
and equal ones meet in a stream.  A task holds some segments, never all of a table.

Null texts are empty.  Rows without a doc_id come first and are one document number;
rows of one doc_id with different texts are taken in the order of a hash of their text, and
of rows that repeat in id and text one is the first and the others its copies.  Empty and
short texts lose nothing; long texts are worked on in stretches.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import in_task, shared_path, text_bytes, text_chunks, tune, written
from tallyspark.llm.shingles import span_hashes
from tallyspark.sources.tables import delete_path

#: Length of the strings, of the grams that anchor them, and grams in a string.
WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Bytes of a text worked on at once.
STRETCH = 1 << 22
#: Segments sorted at once; different segments of one anchor beyond which its strings are dealt out.
SORTED, HOT = 1 << 14, 1 << 16
#: Characters (of eight bytes) of the shallow sort; largest set a blind trie is built of.
SHALLOW, BLIND = 3, 512
FIRST = -(1 << 63)  # stands for a null doc_id

_BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


# ---- Anchors ----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string, number of strings and place in the first string of each anchor of texts laid end to end."""
    starts = [np.arange(a, b - WINDOW + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= WINDOW]
    if not starts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    strings = np.concatenate(starts)
    edge = np.zeros(len(strings), bool)
    edge[np.cumsum([0, *map(len, starts[:-1])])] = True
    grams = np.arange(len(data) - GRAM + 1)
    hashes = span_hashes(data, grams, grams + GRAM, _BYTE)
    # The place breaks ties, leftmost first; it also says which gram was the least.
    low = (hashes & ~_LOW) | grams.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    at = (low[strings] & _LOW).astype(np.int64)
    edge[1:] |= at[1:] != at[:-1]
    first = np.flatnonzero(edge)
    return hashes[at[first]], strings[first], np.diff(np.append(first, len(strings))), at[first] - strings[first]


def _stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, bytes, offsets and each row's offset in its text, of pieces that share 99 bytes."""
    for lo, hi in text_chunks(column):
        data, offsets = text_bytes(column.slice(lo, hi - lo))
        if len(data) <= STRETCH:
            yield np.arange(lo, hi), data, offsets, np.zeros(hi - lo, np.int64)
            continue
        for r in range(hi - lo):
            for a in range(offsets[r], max(offsets[r] + 1, offsets[r + 1] - WINDOW + 1), STRETCH):
                piece = data[a : min(a + STRETCH + WINDOW - 1, offsets[r + 1])]
                yield np.array([lo + r]), piece, np.array([0, len(piece)]), np.array([a - offsets[r]])


def packed(start: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A segment's first string, its strings and the anchor's place in the first, in one number."""
    return start << 16 | n << 8 | place


ANCHORS = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "t", "at")])
#: Within the texts worked on at once an anchor came once; it came again and this is its one row
#: that is shuffled by hash; this is another one of it, known to be shared.
ONCE, AGAIN, KNOWN = range(3)
FOUND = T.StructType([*ANCHORS.fields, T.StructField("state", T.IntegerType())])


def _states(found: np.ndarray) -> np.ndarray:
    _, first, back, times = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
    state = np.where(times[back] > 1, KNOWN, ONCE)
    state[first[times > 1]] = AGAIN
    return state


def _run_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.column("t").to_numpy()
        for rows, data, offsets, shift in _stretches(batch.column("text")):
            found, start, n, place = anchors(data, offsets)
            if len(found):
                row = np.searchsorted(offsets, start, "right") - 1
                at = packed(start - offsets[row] + shift[row], n, place)
                cols = [pa.array(found.view(np.int64)), pa.array(t[rows[row]]), pa.array(at), pa.array(_states(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=FOUND.names)


def _run_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, sorted by hash, whose hash comes again, and those known to be shared."""
    held: pa.RecordBatch | None = None
    again = False  # whether the held row's hash came before
    for batch in batches:
        state = batch.column("state").to_numpy()
        yield batch.filter(pa.array(state == KNOWN)).select(ANCHORS.names)
        batch = batch.filter(pa.array(state != KNOWN))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column("anchor").to_numpy()
        same = h[1:] == h[:-1]
        keep = batch.column("state").to_numpy() == AGAIN
        keep[:-1] |= same
        keep[1:] |= same
        keep[0] |= again
        again = bool(keep[-1])
        held = batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).select(ANCHORS.names)
    if held is not None and again:
        yield held.select(ANCHORS.names)


# ---- Segments ---------------------------------------------------------------------------------

#: No bytes: an equal segment starts earlier.
SEGMENTS = T.StructType(
    [*ANCHORS.fields, T.StructField("doc", T.LongType()), T.StructField("segment", T.BinaryType())]
)


def slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as a binary column."""
    ends = np.cumsum(sizes)
    taken = data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


def _later(code: np.ndarray, t: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows are not the earliest of their code."""
    by = np.lexsort((at, t, doc, code))
    out = np.zeros(len(code), bool)
    out[by[1:]] = code[by][1:] == code[by][:-1]
    return out


def _run_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, doc, marks = batch.column("t").to_numpy(), batch.column("doc").to_numpy(), batch.column("marks")
        for lo, hi in text_chunks(batch.column("text")):
            data, offsets = text_bytes(batch.column("text").slice(lo, hi - lo))
            part = marks.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            flat = part.flatten()
            anchor, at = (flat.field(flat.type.get_field_index(c)).to_numpy() for c in ("anchor", "at"))
            start, size = at >> 16, (at >> 8 & 255) + WINDOW - 1
            inside = start + size <= np.diff(offsets)[row]
            anchor, at, row, start, size = (x[inside] for x in (anchor, at, row, start, size))
            for a in range(0, len(row), 1 << 14):
                x = slice(a, a + (1 << 14))
                mine = [t[lo + row[x]], at[x], doc[lo + row[x]]]
                segment = slices(data, offsets[row[x]] + start[x], size[x])
                later = _later(segment.dictionary_encode().indices.to_numpy(), *mine)
                segment = pc.if_else(pa.array(later), pa.scalar(None, pa.binary()), segment)
                cols = [pa.array(c) for c in (anchor[x], *mine)]
                yield pa.RecordBatch.from_arrays([*cols, segment], names=SEGMENTS.names)


# ---- Deep-shallow sorting ---------------------------------------------------------------------


def blind_sets(keys: list[int]) -> list[list[int]]:
    """Numbers of the keys in key order, equal keys together.

    A node of the blind trie knows one bit, the first in which its two sides differ.  A key
    is led down by those bits alone, compared once with the leaf it ends at, and inserted
    where the first differing bit of that comparison belongs.
    """
    equal = {0: [0]}
    root: int | list = 0
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while type(node) is list:
            node = node[1 + (key >> node[0] & 1)]
        differs = key ^ keys[node]
        if not differs:
            equal[node].append(i)
            continue
        equal[i] = [i]
        bit = differs.bit_length() - 1
        above, node = None, root
        while type(node) is list and node[0] > bit:
            above, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        fresh = [bit, node, i] if key >> bit & 1 else [bit, i, node]
        if above is None:
            root = fresh
        else:
            above[side] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack += [node[2], node[1]]
        else:
            out.append(equal[node])
    return out


def _sets(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal numbers."""
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ids)))


def equal_strings(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string number, set number) of the strings at ``at`` that have an equal in their group."""
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | data[i : len(data) - 7 + i]

    def character(of: np.ndarray, depth: int) -> np.ndarray:
        return eight[at[of] + min(8 * depth, WINDOW - 8)]

    order = np.argsort(group, kind="stable")
    ids = group[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_found = 0

    def report(members: np.ndarray, sets: np.ndarray) -> None:
        nonlocal n_found
        if len(members):
            found.append((members, sets + n_found))
            n_found += int(sets.max()) + 1

    depths = -(-WINDOW // 8)
    for depth in range(depths + 1):
        starts, sizes = _sets(ids)
        size = np.repeat(sizes, sizes)
        if depth == SHALLOW:
            deep = starts[(sizes > 2) & (sizes <= BLIND)]
            for a, n in zip(deep, sizes[(sizes > 2) & (sizes <= BLIND)], strict=True):
                members = order[a : a + n]
                keys = [int.from_bytes(data[p : p + WINDOW].tobytes(), "big") for p in at[members]]
                for k in blind_sets(keys):
                    if len(k) > 1:
                        report(members[k], np.zeros(len(k), np.int64))
            a = starts[sizes == 2]
            left, right = order[a], order[a + 1]
            alike = np.ones(len(a), bool)
            for d in range(depth, depths):
                alike &= character(left, d) == character(right, d)
            left, right = left[alike], right[alike]
            report(np.concatenate([left, right]), np.tile(np.arange(len(left)), 2))
            size = np.where(size <= BLIND, 1, size)
        order, ids = order[size > 1], ids[size > 1]
        if depth == depths:
            report(order, np.repeat(np.arange(len(_sets(ids)[0])), _sets(ids)[1]))
        elif len(order):
            key = character(order, depth)
            by = np.lexsort((key, ids))
            order, ids, key = order[by], ids[by], key[by]
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (key[1:] != key[:-1]))
            ids = np.cumsum(fresh)
    none = np.zeros(0, np.int64)
    members, sets = zip(*found, strict=True) if found else ((none,), (none,))
    return np.concatenate(members), np.concatenate(sets)


MARKS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("t", "doc", "lo", "hi")],  # bytes lo to hi repeat
        T.StructField("string", T.BinaryType()),  # or: a string of a hot anchor, at lo
    ]
)


def _marks(t: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, strings: pa.Array | None = None) -> pa.RecordBatch:
    strings = pa.nulls(len(t), pa.binary()) if strings is None else strings
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (t, doc, lo, hi)), strings], names=MARKS.names)


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Anchor, t, doc, first string, number of strings, anchor's place, bytes and offsets of segments."""
    anchor, t, doc, at = (rows.column(c).to_numpy() for c in ("anchor", "t", "doc", "at"))
    segments = rows.column("segment").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + len(segments) + 1]
    data = np.frombuffer(segments.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return anchor, t, doc, at >> 16, at >> 8 & 255, at & 255, data, offsets - offsets[0]


def _strings(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment number and number in the segment of each string."""
    seg = np.repeat(np.arange(len(n)), n)
    return seg, np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)


def sorted_marks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Marks of the repeated strings of whole groups of different segments."""
    if not rows.num_rows:
        return
    anchor, t, doc, start, n, place, data, offsets = _columns(rows)
    _, group = np.unique(anchor, return_inverse=True)
    shared = np.bincount(group)[group] > 1
    seg, nth = _strings(np.where(shared, n, 0))
    if not len(seg):
        return
    # Equal strings hold their anchor at the same place.
    members, sets = equal_strings(data, offsets[seg] + nth, group[seg] << 8 | (place[seg] - nth))
    if not len(members):
        return
    s, pos = seg[members], start[seg[members]] + nth[members]
    by = np.lexsort((pos, t[s], doc[s], sets))
    later = np.append(False, sets[by][1:] == sets[by][:-1])
    hit = np.sort(members[by][later])  # strings of a segment in order
    s, j = seg[hit], nth[hit]
    first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (j[1:] != j[:-1] + 1)))
    if len(first):
        end = np.append(first[1:], len(hit)) - 1
        yield _marks(t[s[first]], doc[s[first]], start[s[first]] + j[first], start[s[first]] + j[end] + WINDOW)


def dealt_strings(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Every string of the segments by itself."""
    for a in range(0, rows.num_rows, 1 << 10):
        _, t, doc, start, n, _, data, offsets = _columns(rows.slice(a, 1 << 10))
        seg, nth = _strings(n)
        lo = start[seg] + nth
        yield _marks(t[seg], doc[seg], lo, lo + WINDOW, slices(data, offsets[seg] + nth, np.full(len(seg), WINDOW)))


def _same_as_before(batch: pa.RecordBatch, column: str, before: object) -> np.ndarray:
    values = batch.column(column)
    same = np.zeros(batch.num_rows, bool)
    same[1:] = pc.equal(values.slice(1), values.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    same[0] = values[0].as_py() == before
    return same


def _repeated(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Marks of whole segments."""
    t, doc, at = (rows.column(c).to_numpy() for c in ("t", "doc", "at"))
    return _marks(t, doc, at >> 16, (at >> 16) + (at >> 8 & 255) + WINDOW - 1)


def _run_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by (anchor, segment, doc, t, at): equal ones repeat, groups of different ones are suffix-sorted."""
    kept: list[pa.RecordBatch] = []
    size, last, segment, hot = 0, None, None, None
    for batch in batches:
        none = pc.is_null(batch.column("segment"))
        yield _repeated(batch.filter(none))
        batch = batch.filter(pc.invert(none))
        if not batch.num_rows:
            continue
        repeats = _same_as_before(batch, "anchor", last) & _same_as_before(batch, "segment", segment)
        last, segment = batch.column("anchor")[batch.num_rows - 1].as_py(), batch.column("segment")[batch.num_rows - 1].as_py()
        yield _repeated(batch.filter(pa.array(repeats)))
        kept.append(batch.filter(pa.array(~repeats)))
        size += kept[-1].num_rows
        if size < SORTED:
            continue
        rows = pa.Table.from_batches(kept)
        whole = pc.not_equal(rows.column("anchor"), last)
        done, open_rows = rows.filter(whole), rows.filter(pc.invert(whole))
        if hot is not None:
            yield from dealt_strings(done.filter(pc.equal(done.column("anchor"), hot)))
            done = done.filter(pc.not_equal(done.column("anchor"), hot))
        yield from sorted_marks(done)
        if open_rows.num_rows >= HOT or last == hot:
            yield from dealt_strings(open_rows)
            open_rows, hot = open_rows.slice(0, 0), last
        kept, size = open_rows.to_batches(), open_rows.num_rows
    if kept:
        rows = pa.Table.from_batches(kept)
        if hot is not None:
            yield from dealt_strings(rows.filter(pc.equal(rows.column("anchor"), hot)))
            rows = rows.filter(pc.not_equal(rows.column("anchor"), hot))
        yield from sorted_marks(rows)


def _run_equal_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt strings sorted by (string, doc, t, lo): all but the first of equal ones repeat."""
    before = None
    for batch in batches:
        if batch.num_rows:
            repeats = _same_as_before(batch, "string", before)
            before = batch.column("string")[batch.num_rows - 1].as_py()
            rest = batch.filter(pa.array(repeats))
            yield _marks(*(rest.column(c).to_numpy() for c in ("t", "doc", "lo", "hi")))


# ---- Removal ----------------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
KEPT = T.StructType([T.StructField("t", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])


def _run_removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal removed spans of each text and the digest of what is left."""
    spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        found, kept = [], []
        for doc, marks, text in zip(*(batch.column(c) for c in ("doc", "marks", "text")), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            mine = marks.values.filter(pc.equal(marks.values.field("doc"), doc))
            depth = np.zeros(len(data) + 1, np.int64)
            for column, step in (("lo", 1), ("hi", -1)):
                at, n = np.unique(mine.field(column).to_numpy(), return_counts=True)
                depth[at] += step * n
            gone = np.cumsum(depth[:-1]) > 0
            edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
            found.append([{"lo": a, "hi": b} for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)])
            kept.append(hashlib.sha256(data[~gone]).digest())
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(found, spans), pa.array(kept, pa.binary())], names=KEPT.names)


def _bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str, str]:
    """``df``, partitioned by ``key`` into the session's shuffle partitions, as a table bucketed alike in the shared folder; its name and path."""
    spark = df.sparkSession
    name, n = f"repeat_texts_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "repeat-texts")
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name), name, path


def removed(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, spans, n_removed, n_spans, kept_sha256.

    ``spans`` are the maximal removed runs ``(lo, hi)`` of the text's bytes, in order;
    ``kept_sha256`` is the digest of the other bytes, end to end.
    """
    spark = documents.sparkSession
    tune(spark)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("name", F.unhex(F.sha2("text", 256)))
    names = docs.groupBy("name", "doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("n_bytes"))
    names = written(names, "repeat-names")
    seed = 0
    while True:  # a hash that is no other text's
        t = F.xxhash64("name", F.lit(seed))
        if not names.select("name").distinct().groupBy(t.alias("t")).count().where("count > 1").head(1):
            break
        seed += 1
    long_texts = docs.where(F.octet_length("text") >= WINDOW).withColumn("t", t)
    texts = long_texts.groupBy("t").agg(
        F.min(F.struct("doc_id")).alias("first"), F.any_value("name").alias("name"), F.any_value("text").alias("text")
    )
    doc = F.coalesce(F.col("first.doc_id").cast("long"), F.lit(FIRST))
    texts, table_name, path = _bucketed(texts.select("t", doc.alias("doc"), "name", "text"), "t")

    found = texts.select("t", "text").mapInArrow(in_task(_run_anchors), FOUND)
    where = F.when(F.col("state") == KNOWN, F.xxhash64("t", "at")).otherwise(F.col("anchor"))
    shared = found.repartition(where).sortWithinPartitions("anchor").mapInArrow(in_task(_run_shared), ANCHORS)
    marks = shared.groupBy("t").agg(F.collect_list(F.struct("anchor", "at")).alias("marks"))
    cut = texts.select("t", "doc", "text").join(marks, "t").select("t", "doc", "text", "marks").mapInArrow(in_task(_run_cut), SEGMENTS)
    order = ["anchor", "segment", "doc", "t", "at"]
    where = F.when(F.col("segment").isNull(), F.xxhash64("t", "at")).otherwise(F.col("anchor"))
    repeats = written(cut.repartition(where).sortWithinPartitions(*order).mapInArrow(in_task(_run_sorted), MARKS), "repeat-marks")
    dealt = repeats.where("string is not null").repartition("string").sortWithinPartitions("string", "doc", "t", "lo")
    spans = repeats.where("string is null").select("t", "doc", "lo", "hi").unionByName(
        dealt.mapInArrow(in_task(_run_equal_strings), MARKS).select("t", "doc", "lo", "hi")
    )
    spans = spans.groupBy("t").agg(F.collect_list(F.struct("doc", "lo", "hi")).alias("marks"))
    left = texts.select("t", "doc", "text").join(spans, "t").select("t", "doc", "text", "marks")
    left = left.mapInArrow(in_task(_run_removed), KEPT)
    left = written(texts.select("t", "doc").join(left, "t", "left"), "repeat-kept")
    spark.sql(f"DROP TABLE {table_name}")
    delete_path(spark, path)

    # Rows of one id and text: the first of the least id stands for the text, in the others every byte goes.
    rows = names.withColumns({"t": t, "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))})
    rows = rows.join(left, "t", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    stands = (F.col("n_bytes") < WINDOW) | ((F.col("id") == F.col("doc")) & (F.col("nth") == 1))
    none = F.array().cast(SPANS)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    nothing = F.lit(hashlib.sha256(b"").digest())
    rows = rows.select(
        "doc_id", "n_bytes",
        F.when(stands, F.coalesce("spans", none)).otherwise(whole).alias("spans"),
        F.when(stands, F.coalesce("kept", "name")).otherwise(nothing).alias("kept"),
    )
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return rows.select(
        "doc_id", "n_bytes", "spans", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.lower(F.hex("kept")).alias("kept_sha256"),
    )
