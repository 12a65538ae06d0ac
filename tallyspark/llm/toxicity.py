"""Toxicity scorer: bidirectional GRU with attention pooling over character and word inputs.

A token is a run of ASCII letters, digits and bytes beyond ASCII, lower-cased;
a run of more than 24 bytes is several tokens.  Its input vector joins a learned
embedding of the hashed word with the mean of learned embeddings of its hashed
character 4-grams and of its first five characters.  A forward and a backward
gated recurrent unit read windows of 64 tokens that start every 32 tokens, so
that the whole text is covered twice; attention pools the hidden states and a
logistic unit scores the window.  A document's score is that of its most toxic
window, learned from document labels only: the gradient flows through the
highest-scoring window (numpy, Adagrad, fixed seed).

Input products are computed once per distinct token of a batch, and the
recurrence runs over all windows of a batch at once.  Null, empty and wordless
texts are one window without tokens.  Labels, lang, source and doc_id never
reach the features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm import shingles as S
from tallyspark.llm.common import release_memory, rowwise, text_bytes, text_chunks, tune
from tallyspark.llm.labels import class_shift, training_sample

WINDOW, STRIDE, PIECE = 64, 32, 24
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTEND = 1 << 12, 1 << 14, 8, 10, 8
#: Bounds of the training sample: documents of either class, bytes of a text.
PER_CLASS, MAX_BYTES = 1500, 1 << 15
#: Text bytes and windows worked on at once.
CHUNK, SLICE = 2 << 20, 4096
#: Windows worked on at least: numpy sums a lone column in another order than columns side by side.
LEAST = 8

_GRAM = np.random.default_rng(0xC4A2).integers(1, 1 << 63, (5, 256), dtype=np.uint64)
_GRAM[:, 65:91] = _GRAM[:, 97:123]


class Tokens:
    """Tokens of a string column: distinct tokens with their hashed inputs, and each text's sequence."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        s, e = S.run_spans(data, offsets)
        pieces = np.maximum(1, -(-(e - s) // PIECE))
        if len(s) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            s = np.repeat(s, pieces) + nth * PIECE
            e = np.minimum(s + PIECE, np.repeat(e, pieces))
        self.bounds = np.searchsorted(s, offsets)
        hashes = S.span_hashes(data, s, e)
        _, first, self.sequence = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        self.words = (hashes[first] >> np.uint64(64 - 12)).astype(np.int64)
        # Character 4-grams of each distinct token, and one gram of its first five characters.
        n = np.maximum(1, e - s - 3)
        self.grams = np.zeros(len(s) + 1, np.int64)
        np.cumsum(n + 1, out=self.grams[1:])
        owner = np.repeat(np.arange(len(s)), n + 1)
        nth = np.arange(self.grams[-1]) - self.grams[owner]
        head = nth == n[owner]
        at = np.where(head, s[owner], s[owner] + nth)
        acc = np.where(head, np.uint64(77), np.uint64(5))
        for i in range(5):
            inside = (at + i < e[owner]) & (head | (i < 4))
            acc = acc + np.where(inside, _GRAM[i][data[np.minimum(at + i, len(data) - 1)]] if len(data) else 0, np.uint64(0))
        self.chars = (S.mix(acc) >> np.uint64(64 - 14)).astype(np.int64)
        self.owner = owner

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of every window (-1: none), and each text's offset into the windows."""
        n = np.diff(self.bounds)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        text = np.repeat(np.arange(len(n)), count)
        start = self.bounds[text] + (np.arange(at[-1]) - at[text]) * STRIDE
        place = start[:, None] + np.arange(WINDOW)
        inside = place < self.bounds[text + 1][:, None]
        if not len(self.sequence):
            return np.full((int(at[-1]), WINDOW), -1), at
        return np.where(inside, self.sequence[np.minimum(place, len(self.sequence) - 1)], -1), at


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f32 = np.float32
    p = {"word": r.standard_normal((WORD_ROWS, DIM)) * 0.1, "char": r.standard_normal((CHAR_ROWS, DIM)) * 0.1}
    for side in "fb":  # forward, backward: gates r, z, n
        p["W" + side] = r.standard_normal((2 * DIM, 3 * HIDDEN)) * 0.4
        p["R" + side] = r.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.25
        p["i" + side] = np.zeros(3 * HIDDEN)
        p["c" + side] = np.zeros(HIDDEN)
    p["A"] = r.standard_normal((2 * HIDDEN, ATTEND)) * 0.3
    p["v"] = r.standard_normal(ATTEND) * 0.5
    p["o"] = r.standard_normal(2 * HIDDEN) * 0.5
    p["d"] = np.zeros(1)
    return {k: a.astype(f32) for k, a in p.items()}


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def token_inputs(p, tokens: Tokens) -> np.ndarray:
    """Input vector of each distinct token; one more row of zeros stands for no token."""
    out = np.zeros((len(tokens.words) + 1, 2 * DIM), p["word"].dtype)
    if len(tokens.words):
        out[:-1, :DIM] = p["word"][tokens.words]
        sums = np.add.reduceat(p["char"][tokens.chars], tokens.grams[:-1])
        out[:-1, DIM:] = sums / np.diff(tokens.grams)[:, None]
    return out


def _recur(p, side: str, gates: np.ndarray, ids: np.ndarray, keep: bool):
    """Hidden states (time, window, hidden) of one direction, with what its gradient needs."""
    steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    rec, bias, h2 = p["R" + side], p["c" + side], 2 * HIDDEN
    h = np.zeros((len(ids), HIDDEN), gates.dtype)
    states = np.zeros((WINDOW, len(ids), HIDDEN), gates.dtype)
    tape = {}
    for t in steps:
        step = ids[:, t]
        valid = (step >= 0)[:, None]
        if not valid.any():
            states[t] = h
            continue
        x = gates[step]
        u = h @ rec if keep else rowwise(h, rec)
        rz = _sigmoid(x[:, :h2] + u[:, :h2])
        reset, update = rz[:, :HIDDEN], rz[:, HIDDEN:]
        un = u[:, h2:] + bias
        n = np.tanh(x[:, h2:] + reset * un)
        new = np.where(valid, n + update * (h - n), h)
        if keep:
            tape[t] = (h, reset, update, un, n, valid)
        h = new
        states[t] = h
    return states, tape


def _pool(p, states: np.ndarray, ids: np.ndarray):
    u = np.tanh(rowwise(states.reshape(-1, 2 * HIDDEN), p["A"]).reshape(*states.shape[:2], -1))
    s = np.where((ids >= 0).T, (u * p["v"]).sum(axis=2), -30.0)
    e = np.exp(s - s.max(axis=0))
    a = (e / e.sum(axis=0)).astype(states.dtype)
    z = np.einsum("tn,tnh->nh", a, states)
    return (z * p["o"]).sum(axis=1) + p["d"][0], (u, a, z)


def window_logits(p, inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logit of each window, to the last bit whatever windows are beside it."""
    gates = {side: rowwise(inputs, p["W" + side]) + p["i" + side] for side in "fb"}
    out = np.zeros(len(ids), np.float64)
    for i in range(0, len(ids), SLICE):
        part = ids[i : i + SLICE]
        size = len(part)
        if size < LEAST:
            part = np.vstack([part, np.full((LEAST - size, part.shape[1]), -1)])
        states = np.concatenate([_recur(p, side, gates[side], part, False)[0] for side in "fb"], axis=2)
        out[i : i + size] = _pool(p, states, part)[0][:size]
    return out


def gradients(p, tokens: Tokens, ids: np.ndarray, y: np.ndarray):
    """Gradients of the mean logistic loss over one window for each label."""
    inputs = token_inputs(p, tokens)
    runs = {s: _recur(p, s, inputs @ p["W" + s] + p["i" + s], ids, True) for s in "fb"}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    logit, (u, a, z) = _pool(p, states, ids)
    e = ((_sigmoid(logit) - y) / len(y)).astype(states.dtype)
    g = {"o": z.T @ e, "d": e.sum(keepdims=True)}
    dz = e[:, None] * p["o"]
    da = np.einsum("nh,tnh->tn", dz, states)
    ds = a * (da - (a * da).sum(axis=0))
    du = ds[:, :, None] * p["v"] * (1 - u * u)
    g["v"] = np.einsum("tn,tna->a", ds, u)
    g["A"] = np.einsum("tnh,tna->ha", states, du)
    dstates = a[:, :, None] * dz + du @ p["A"].T
    dinputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        rec, tape = p["R" + side], runs[side][1]
        grec, gbias = np.zeros_like(rec), np.zeros(HIDDEN, rec.dtype)
        dgates = np.zeros((len(inputs), 3 * HIDDEN), rec.dtype)
        dh = np.zeros((len(ids), HIDDEN), rec.dtype)
        steps = range(WINDOW - 1, -1, -1) if side == "f" else range(WINDOW)
        for t in steps:
            dh = dh + dstates[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            if t not in tape:
                continue
            h, reset, update, un, n, valid = tape[t]
            dnew = np.where(valid, dh, 0)
            dn = dnew * (1 - update) * (1 - n * n)
            dupdate = dnew * (h - n) * update * (1 - update)
            dreset = dn * un * reset * (1 - reset)
            dun = dn * reset
            du3 = np.concatenate([dreset, dupdate, dun], axis=1)
            grec += h.T @ du3
            gbias += dun.sum(axis=0)
            np.add.at(dgates, ids[:, t], np.concatenate([dreset, dupdate, dn], axis=1))
            dh = np.where(valid, dnew * update, dh) + du3 @ rec.T
        g["R" + side], g["c" + side] = grec, gbias
        g["W" + side], g["i" + side] = inputs.T @ dgates, dgates[:-1].sum(axis=0)
        dinputs += dgates @ p["W" + side].T
    dinputs = dinputs[:-1]
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], tokens.words, dinputs[:, :DIM])
    np.add.at(g["char"], tokens.chars, (dinputs[:, DIM:] / np.diff(tokens.grams)[:, None])[tokens.owner])
    return g


def train(texts: list[str], y: list[int], updates: int = 800, batch: int = 50, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights learned from texts and labels; without both classes, a constant by the share of ones."""
    p = initial(seed)
    target = np.array(y, np.float32)
    if not len(y) or target.min() == target.max():
        p["o"][:] = 0
        p["d"][:] = np.log((target.sum() + 1) / (len(y) - target.sum() + 1))
        return p
    tokens = Tokens(pa.array(texts, pa.string()))
    ids, at = tokens.windows()
    r = np.random.default_rng(seed)
    seen = {k: np.full_like(a, 1e-6) for k, a in p.items()}
    for epoch in range(max(10, -(-updates * batch // len(y)) if len(y) * 60 > updates * batch else 60)):
        logits = window_logits(p, token_inputs(p, tokens), ids)
        best = np.array([lo + int(np.argmax(logits[lo:hi])) for lo, hi in zip(at[:-1], at[1:], strict=True)])
        if epoch == 0:  # an untrained choice says nothing: take windows at random
            best = at[:-1] + (r.random(len(y)) * np.diff(at)).astype(np.int64)
        order = r.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            g = gradients(p, *_narrow(tokens, ids[best[pick]]), target[pick])
            for k in p:
                g[k] = np.clip(g[k], -1, 1)
                seen[k] += g[k] ** 2
                p[k] = p[k] - (0.1 if k in ("word", "char") else 0.03) * g[k] / np.sqrt(seen[k])
    return {k: a.astype(np.float32) for k, a in p.items()}


def _narrow(tokens: Tokens, ids: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """Only the tokens that occur in ``ids``, renumbered."""
    used = np.unique(ids)
    used = used[used >= 0]
    number = np.full(len(tokens.words) + 1, -1)
    number[used] = np.arange(len(used))
    small = Tokens.__new__(Tokens)
    small.words = tokens.words[used]
    size = np.diff(tokens.grams)[used]
    small.grams = np.zeros(len(used) + 1, np.int64)
    np.cumsum(size, out=small.grams[1:])
    small.owner = np.repeat(np.arange(len(used)), size)
    small.chars = tokens.chars[tokens.grams[used][small.owner] + np.arange(small.grams[-1]) - small.grams[small.owner]]
    return small, number[ids]


def score_column(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """Score of each whole text: its most toxic window."""
    out = [np.zeros(0)]
    for lo, hi in text_chunks(column, CHUNK):
        tokens = Tokens(column.slice(lo, hi - lo))
        ids, at = tokens.windows()
        out.append(_sigmoid(np.maximum.reduceat(window_logits(p, token_inputs(p, tokens), ids), at[:-1])))
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> dict[str, np.ndarray]:
    """Train on the labelled documents whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``."""
    tune(docs.sparkSession)
    rows = training_sample(docs, labels, "toxic", modulus, held_out, PER_CLASS, MAX_BYTES)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    model["d"] = model["d"] + np.float32(class_shift(labels, "toxic", modulus, held_out, [y for _, _, y in rows]))
    release_memory()
    return model
