"""Cheapest repair of conversations, by a rank-convergence parallel Viterbi.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``.  Its
rows, taken by turn (nulls first; ties by role, then text), may be kept (0), given
the role user or assistant (1) or deleted (2); an empty user or assistant row may
be inserted anywhere (5).  Blank rows and later copies of a row (role and text) must
go; a truncated row that stays costs 5 more.  Of the cheapest repairs the one whose
string of edit initials (D, I, K, R) is ASCII-least is taken.

The cost still to pay is a vector over four states (nothing yet, after s, after u,
after a), and a row is a min-plus matrix.  A conversation may be a third of all
rows, so its rows are numbered in order over the whole table and cut into chunks of
at most ``CHUNK``:

1. every chunk runs backwards; the last of a conversation from the true end vector,
   the others from a speculative one (that of an end);
2. fix-up passes: a chunk whose start vector in the chunk behind it differs by more than
   a constant from the vector it used is run again, in step with its old run, and
   stops where the two differ by a constant only.  Vectors are kept with their
   least entry at 0, so "differ by a constant" is equality;
3. every chunk traces its least edits from each of the four states; a chain over the chunks
   (four numbers each) settles the state in which each of them begins;
4. the edits are read off the stitched vectors from that state.

Rows travel once by range and, without those that must go, once by conversation to be
hashed: a digest over a whole conversation is sequential, so this last step streams a
conversation through one task, holding no more than a chunk of it and its audit.

Nulls in role and text count as one space, which is no legal initial and blank.  A null turn
comes first and has no part in gaps; rows without a conv_id form one conversation.  Empty
roles are no legal initial.  Repeated rows are aggregated before they move: all but the
first are copies.  Long texts are only hashed.  An empty table gives no rows; a
conversation is returned only if it has rows.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.llm.common import in_task, tune, written

#: Rows of a chunk.
CHUNK = 256
SPACES = " \t\n\x0b\f\r"
LETTERS = "DIKR"
D, I, K, R = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
#: The state after an inserted or reroled row.
NEXT = np.array([U, U, A, U])
INF = 1 << 20
#: A row's symbol: 3 * (0 s, 1 u, 2 a, 3 other) + (0 sound, 1 truncated, 2 must go); PAD is no row.
PAD = 12
OK, CUT, GONE = range(3)


def _kept_state(kind: int, state: int) -> int | None:
    if kind == 0 and state == START:
        return S
    if kind == 1 and state != U:
        return U
    return A if kind == 2 and state == U else None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus matrix of each symbol with insertions before it; state and cost of keeping a row."""
    rows = np.full((PAD + 1, 4, 4), INF)
    state, cost = np.zeros((PAD + 1, 4), np.int64), np.full((PAD + 1, 4), INF)
    inserts = np.full((4, 4), INF)
    for s in range(4):
        inserts[s, s] = 0
        inserts[s, NEXT[s]] = INSERT
        inserts[s, NEXT[NEXT[s]]] = min(inserts[s, NEXT[NEXT[s]]], 2 * INSERT)
    for sym in range(PAD):
        kind, fault = divmod(sym, 3)
        for s in range(4):
            rows[sym, s, s] = DELETE
            if fault == GONE:
                continue
            more = TRUNCATED if fault == CUT else 0
            rows[sym, s, NEXT[s]] = min(rows[sym, s, NEXT[s]], REROLE + more)
            if (to := _kept_state(kind, s)) is not None:
                rows[sym, s, to] = min(rows[sym, s, to], KEEP + more)
                state[sym, s], cost[sym, s] = to, KEEP + more
    out = np.minimum.reduce([inserts[None, :, t, None] + rows[:, None, t, :] for t in range(4)])
    out[PAD] = np.where(np.eye(4, dtype=bool), 0, INF)
    return out, state, cost


STEP, KEPT_STATE, KEPT_COST = _tables()
END = np.array([0, 2 * INSERT, INSERT, 0])


def normal(vectors: np.ndarray) -> np.ndarray:
    return vectors - vectors.min(axis=-1, keepdims=True)


def backward(syms: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Vectors before each row and after the last of the chunks (chunks x rows symbols)."""
    out = np.empty((syms.shape[1] + 1, len(syms), 4), np.int64)
    out[-1] = end
    for i in range(syms.shape[1] - 1, -1, -1):
        out[i] = (STEP[syms[:, i]] + out[i + 1][:, None, :]).min(axis=2)
    return out


def fixed_up(syms: np.ndarray, old_end: np.ndarray, old_start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start vectors for new end vectors: runs in step with the old run while the two differ by more than a constant."""
    out = old_start.copy()
    live = np.arange(len(syms))
    old, new = normal(old_end), normal(end)
    for i in range(syms.shape[1] - 1, -1, -1):
        live = live[(old[live] != new[live]).any(axis=1)]
        if not len(live):
            return out
        step = STEP[syms[live, i]]
        old[live] = normal((step + old[live][:, None, :]).min(axis=2))
        new[live] = normal((step + new[live][:, None, :]).min(axis=2))
    out[live] = new[live]
    return out


def traced(syms: np.ndarray, end: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits from the given states: a code a row (letter + 4 * insertions before it), insertions after the last row, end states."""
    costs = backward(syms, end)
    state, every = state.copy(), np.arange(len(syms))
    codes = np.zeros(syms.shape, np.uint8)

    def insert(here: np.ndarray, rows: np.ndarray) -> np.ndarray:
        to = NEXT[state]
        rows = rows & (here[every, state] == INSERT + here[every, to])
        state[rows] = to[rows]
        return rows

    for i in range(syms.shape[1]):
        sym, here, then = syms[:, i], costs[i], costs[i + 1]
        real = sym != PAD
        deleted = real & (here[every, state] == DELETE + then[every, state])
        n = insert(here, real & ~deleted).astype(np.uint8)
        n += insert(here, n > 0)
        to = KEPT_STATE[sym, state]
        kept = real & ~deleted & (here[every, state] == KEPT_COST[sym, state] + then[every, to])
        moved = real & ~deleted & ~kept
        state = np.where(kept, to, np.where(moved, NEXT[state], state))
        codes[:, i] = np.where(deleted, D, np.where(kept, K, R)) + 4 * n
    tail = insert(END[None, :].repeat(len(syms), 0), last).astype(np.int64)
    tail += insert(END[None, :].repeat(len(syms), 0), tail > 0)
    return codes, tail, state


# ---- Spark ------------------------------------------------------------------------------------


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in order, written: (at, conv_id, turn, role, text, n, sym) and what each adds to the faults."""
    space = F.lit(" ")
    once = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    once = once.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    once = once.withColumns(
        {
            "blank": trimmed == "",
            "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
            "text_name": F.sha2("text", 256),
        }
    )
    once = written(once, "repair-once")
    # Rows that come back at another turn; most rows have no part in this join.
    keys = ["role", "text_name"]
    first = once.where("not blank").groupBy("conv_id", *keys).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    first = first.where("turns > 1").select(F.col("conv_id").alias("conv"), *keys, "first")
    same = F.col("o.conv_id").eqNullSafe(F.col("f.conv")) & (F.col("o.role") == F.col("f.role")) & (F.col("o.text_name") == F.col("f.text_name"))
    both = once.alias("o").join(first.alias("f"), same & ~F.col("o.blank"), "left").select("o.*", "f.first")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("blank") | later, GONE).when(F.col("cut"), CUT).otherwise(OK)
    initial = _initial(F.col("role"))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    both = both.select(
        "conv_id", "turn", "role", "text", "n", (3 * kind + fault).alias("sym"),
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).when(later, F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
        F.when(fault == CUT, 1).otherwise(0).alias("truncated"),
    )
    order = ["conv_id", "turn", "role", "text"]
    both = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(both, "repair-rows")


def chunked(rows: DataFrame) -> DataFrame:
    """At most ``CHUNK`` rows that follow each other: (head, next_head, lone, conv_id, syms, ns, initials), written."""
    items = F.sort_array(F.collect_list(F.struct("at", "sym", "n", _initial(F.col("role")).alias("initial"))))
    cut = rows.groupBy("conv_id", F.expr(f"at div {CHUNK}").alias("block")).agg(items.alias("items"))
    cut = cut.select(
        "conv_id", F.col("items")[0]["at"].alias("head"), F.col("items.sym").alias("syms"),
        F.col("items.n").alias("ns"), F.col("items.initial").alias("initials"),
    )
    w = Window.partitionBy("conv_id").orderBy("head")
    cut = cut.withColumns({"next_head": F.lead("head").over(w), "before": F.lag("head").over(w)})
    return written(cut.withColumn("lone", F.col("next_head").isNull() & F.col("before").isNull()).drop("before"), "repair-chunks")


def _by_length(lists: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, padded symbols) of lists of like length."""
    size = np.array([len(x) for x in lists])
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(level):
        at = np.flatnonzero(level == b)
        syms = np.full((len(at), size[at].max()), PAD)
        for i, x in enumerate(at):
            syms[i, : size[x]] = lists[x]
        yield at, syms


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(batch.schema.get_field_index(name)).to_pylist(), np.int64).reshape(-1, 4)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


VECTORS = T.StructType(
    [
        T.StructField("head", T.LongType()),
        T.StructField("next_head", T.LongType()),
        T.StructField("used", T.ArrayType(T.LongType())),
        T.StructField("start", T.ArrayType(T.LongType())),
    ]
)


def _run_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start vectors; a chunk with ``old_used`` and ``old_start`` is fixed up, one without is run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        used = normal(_vectors(batch, "used"))
        start = np.zeros_like(used)
        again = "old_start" in batch.schema.names
        for at, syms in _by_length(batch.column("syms").to_pylist()):
            if again:
                start[at] = fixed_up(syms, _vectors(batch, "old_used")[at], _vectors(batch, "old_start")[at], used[at])
            else:
                start[at] = normal(backward(syms, used[at])[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("head"), batch.column("next_head"), _lists(used), _lists(start)], names=VECTORS.names
        )


def converged(chunks: DataFrame) -> DataFrame:
    """Per chunk of conversations of several chunks: the vector behind it and its start vector, right up to a constant."""
    end = F.array(*[F.lit(int(x)) for x in END]).cast("array<long>")
    linked = chunks.where("not lone")
    have = linked.select("head", "next_head", "syms", end.alias("used")).mapInArrow(in_task(_run_back), VECTORS)
    have = written(have, "repair-vectors")
    while True:
        behind = have.select(F.col("head").alias("next_head"), F.col("start").alias("now"))
        stale = written(have.join(behind, "next_head").where("used <> now"), "repair-stale")
        if not stale.count():
            return have
        work = stale.select("head", "next_head", F.col("now").alias("used"), F.col("used").alias("old_used"), F.col("start").alias("old_start"))
        work = work.join(linked.select("head", "syms"), "head").select("head", "next_head", "syms", "used", "old_used", "old_start")
        fresh = work.mapInArrow(in_task(_run_back), VECTORS)
        have = written(have.join(stale.select("head"), "head", "left_anti").unionByName(fresh), "repair-vectors")


def _run_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a chunk for each state before it."""
    for batch in batches:
        used = _vectors(batch, "used") if batch.num_rows else np.zeros((0, 4), np.int64)
        out = np.zeros_like(used)
        for at, syms in _by_length(batch.column("syms").to_pylist()):
            for s in range(4):
                out[at, s] = traced(syms, used[at], np.full(len(at), s), np.zeros(len(at), bool))[2]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("head"), batch.column("used"), _lists(out)], names=["conv_id", "head", "used", "states"]
        )


def _run_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk, conversation after conversation."""
    conv, state, begun = None, START, False
    for batch in batches:
        before = []
        for c, states in zip(batch.column("conv_id").to_pylist(), batch.column("states").to_pylist(), strict=True):
            if not begun or c != conv:
                conv, state, begun = c, START, True
            before.append(state)
            state = states[state]
        yield pa.RecordBatch.from_arrays(
            [batch.column("head"), batch.column("used"), pa.array(before, pa.int64())], names=["head", "used", "state"]
        )


TRACES = T.StructType([T.StructField("head", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("tail", T.LongType())])


def _run_trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("syms").to_pylist()
        used, state = _vectors(batch, "used"), batch.column("state").to_numpy()
        last = np.array(batch.column("last").to_pylist(), bool)
        codes: list[bytes] = [b""] * len(lists)
        tail = np.zeros(len(lists), np.int64)
        for at, syms in _by_length(lists):
            found, tail[at], _ = traced(syms, used[at], state[at], last[at])
            for i, x in enumerate(at):
                codes[x] = found[i, : len(lists[x])].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("head"), pa.array(codes, pa.binary()), pa.array(tail)], names=TRACES.names)


def edits(chunks: DataFrame) -> DataFrame:
    """The least edits of each chunk: (head, codes, tail), written."""
    keys = T.StructType([chunks.schema["conv_id"], *VECTORS.fields[:1], *VECTORS.fields[2:3]])
    states = T.StructType([*keys.fields, T.StructField("states", T.ArrayType(T.LongType()))])
    begun = T.StructType([*keys.fields[1:], T.StructField("state", T.LongType())])
    linked = chunks.join(converged(chunks).select("head", "used"), "head").select("conv_id", "head", "used", "syms")
    chain = linked.mapInArrow(in_task(_run_states), states).repartition("conv_id").sortWithinPartitions("conv_id", "head")
    chain = chain.mapInArrow(in_task(_run_chain), begun)
    end = F.array(*[F.lit(int(x)) for x in END]).cast("array<long>")
    last = F.col("next_head").isNull().alias("last")
    lone = chunks.where("lone").select("head", "syms", end.alias("used"), F.lit(START).cast("long").alias("state"), last)
    more = chunks.join(chain, "head").select("head", "syms", "used", "state", last)
    return written(lone.unionByName(more).mapInArrow(in_task(_run_trace), TRACES), "repair-edits")


LEGAL = {"su", "ua", "au"}


class _Repaired:
    """What is said of one conversation, row after row."""

    def __init__(self):
        self.hash, self.lines, self.state = hashlib.sha256(), 0, START
        self.audit: list[str] = []
        self.cost = self.illegal = 0
        self.initial: str | None = None
        self.codes, self.at = b"", 0

    def line(self, role: str, text: str = "") -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def inserted(self, n: int) -> None:
        for _ in range(n):
            self.state = int(NEXT[self.state])
            self.audit.append("I")
            self.cost += INSERT
            self.line(ROLES[self.state])

    def chunk(self, head: int, codes: bytes, tail: int, syms: list[int], ns: list[int], initials: list[str]) -> None:
        self.head, self.codes, self.tail, self.syms, self.ns, self.at = head, codes, tail, syms, ns, 0
        for initial, n in zip(initials, ns, strict=True):
            self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + n - 1
            self.initial = initial

    def until(self, i: int) -> None:
        """The rows before row ``i`` of the chunk: all of them go."""
        for x in range(self.at, i):
            self.gone(self.ns[x])
        self.at = i

    def gone(self, n: int) -> None:
        self.audit.append("D" * n)
        self.cost += DELETE * n

    def row(self, at: int, role: str, text: str) -> None:
        self.until(at - self.head)
        letter, n = self.codes[self.at] & 3, self.codes[self.at] >> 2
        sym, copies = self.syms[self.at], self.ns[self.at]
        self.at += 1
        if letter == D:
            return self.gone(copies)
        self.inserted(n)
        self.audit.append(LETTERS[letter])
        self.cost += (REROLE if letter == R else KEEP) + (TRUNCATED if sym % 3 == CUT else 0)
        self.state = int(KEPT_STATE[sym, self.state]) if letter == K else int(NEXT[self.state])
        self.line(role if letter == K else ROLES[self.state], text)
        self.gone(copies - 1)
        return None

    def close(self) -> None:
        """The end of a chunk."""
        if self.codes:
            self.until(len(self.codes))
            self.inserted(self.tail)
            self.codes = b""


def _run_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, now = None, None
    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]

    def result(kind: pa.DataType) -> pa.RecordBatch:
        now.close()
        cols = [pa.array([conv], kind), pa.array([now.illegal], pa.int64()), pa.array([now.cost], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array(["".join(now.audit)]), pa.array([now.hash.hexdigest()])], names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != conv:
                if now is not None:
                    yield result(kind)
                conv, now = row["conv_id"], _Repaired()
            if row["side"] == 0:
                now.close()
                now.chunk(row["at"], row["codes"], row["tail"], row["syms"], row["ns"], row["initials"])
            else:
                now.row(row["at"], row["role"], row["text"])
    if now is not None:
        yield result(kind)


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (see the module).

    ``gaps`` are the turns missing between the first and the last; ``illegal`` counts
    neighbours, as they come, whose initials are not su, ua or au; ``repaired_sha256`` is that of the
    repaired ``role:text`` lines joined by newlines.
    """
    tune(conversations.sparkSession)
    rows = ordered(conversations)
    chunks = chunked(rows)
    marks = chunks.join(edits(chunks), "head")
    marks = marks.select("conv_id", F.col("head").alias("at"), F.lit(0).alias("side"), "codes", "tail", "syms", "ns", "initials")
    live = rows.where(f"sym % 3 <> {GONE}").select("conv_id", "at", F.lit(1).alias("side"), "role", "text")
    both = marks.unionByName(live, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "at", "side")
    schema = T.StructType(
        [
            rows.schema["conv_id"], T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()),
            T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
        ]
    )
    result = written(both.mapInArrow(in_task(_run_repaired), schema), "repair-result")
    faults = ["blank", "duplicate", "truncated"]
    counts = rows.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in faults]).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in faults],
    )
    counts = counts.withColumnRenamed("conv_id", "conv")
    return result.join(counts, result.conv_id.eqNullSafe(counts.conv)).select(
        "conv_id", "gaps", *faults, "illegal", "cost", "audit", "repaired_sha256"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its ``.!?``, 3 comes twice, 4 is a user's."""
    space = F.lit(" ")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    rows = rows.where("fate <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times")
