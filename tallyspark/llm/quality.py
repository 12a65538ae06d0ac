"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak, Welling, 2018).

A document is a bag of passages of 64 words.  A passage is described by hashed
word counts, counts of word shapes (classes of a word's first and last bytes)
and a few text statistics; a learned layer encodes it as ``h = tanh(W x + b)``.
Gated attention ``softmax_p(w . (tanh(V h) * sigmoid(U h)))`` weighs the
passages, and a logistic unit on the weighted representation scores the document.
Only document labels are used for training (numpy, Adam, fixed seed).

Scoring reads every passage of whole texts in ``mapInArrow``; the weights (about
60 kB) travel with the task.  Null and empty texts are one passage without words.
Labels, lang, source and doc_id never reach the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import shingles as S
from tallyspark.llm.common import in_task, release_memory, rowwise, text_bytes, text_chunks, tune
from tallyspark.llm.labels import class_shift, training_sample

PASSAGE = 64
BAG, CLASSES, STATS = 256, 16, 9
FEATURES = BAG + 2 * CLASSES * CLASSES + STATS
HIDDEN, GATE = 24, 12
#: Bounds of the training sample: documents of either class, bytes of a text.
PER_CLASS, MAX_BYTES = 1000, 1 << 16


def _byte_classes() -> np.ndarray:
    """0 lower letter, 1 upper, 2 digit, 3 beyond ASCII, 4 control, the rest by common symbols."""
    c = np.full(256, 15, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:], c[:32] = 0, 1, 2, 3, 4
    for i, group in enumerate((".", ",", "!", "?", "*#%&$", "|", "-_", "\"'()[]{}<>", ":;", "/\\@=+~^`")):
        c[np.frombuffer(group.encode(), np.uint8)] = 5 + i
    return c


_CLASS = _byte_classes()


def passage_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts, and each text's offset into them (at least one each)."""
    data, offsets = text_bytes(column)
    starts, ends = S.word_spans(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    passages = np.maximum(1, -(-n // PASSAGE))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(passages, out=at[1:])
    total = int(at[-1])
    x = np.zeros((total, FEATURES), np.float32)
    x[:, -1] = 1
    if not len(starts):
        return x, at
    owner = np.repeat(np.arange(len(n)), n)
    place = at[owner] + (np.arange(len(starts)) - bounds[owner]) // PASSAGE
    hashes = S.span_hashes(data, starts, ends)
    count = np.bincount(place, minlength=total).astype(np.float32)
    scale = 1 / np.maximum(count, 1)

    def histogram(index: np.ndarray, width: int) -> np.ndarray:
        got = np.bincount(place * width + index, minlength=total * width).reshape(total, width)
        return got.astype(np.float32) * scale[:, None]

    x[:, :BAG] = np.sqrt(histogram((hashes >> np.uint64(56)).astype(np.int64), BAG))
    last, before = _CLASS[data[ends - 1]].astype(np.int64), _CLASS[data[np.maximum(ends - 2, starts)]]
    first, second = _CLASS[data[starts]].astype(np.int64), _CLASS[data[np.minimum(starts + 1, ends - 1)]]
    wide = CLASSES * CLASSES
    x[:, BAG : BAG + wide] = histogram(first * CLASSES + second, wide)
    x[:, BAG + wide : BAG + 2 * wide] = histogram(last * CLASSES + before, wide)
    stats = x[:, -STATS:]
    length = (ends - starts).astype(np.float32)
    classes = np.zeros((4, len(data) + 1), np.int64)
    kind = _CLASS[data]
    for i, test in enumerate((kind == 1, kind == 2, kind == 3, kind >= 5)):
        np.cumsum(test, out=classes[i, 1:])
    size = np.maximum(np.bincount(place, length, total), 1)
    for i in range(4):
        stats[:, i] = np.bincount(place, classes[i, ends] - classes[i, starts], total) / size
    stats[:, 4] = np.bincount(place, length, total) * scale / 10
    same = np.zeros(len(starts), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    stats[:, 5] = np.bincount(place, same, total) * scale
    order = np.lexsort((hashes, place))
    new = np.ones(len(order), np.float32)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (place[order][1:] != place[order][:-1])
    stats[:, 6] = np.bincount(place[order], new, total) * scale
    stats[:, 7] = np.log1p(count) / 5
    return x, at


def _softmax(s: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.maximum.reduceat(s, at[:-1])[owner])
    return e / np.add.reduceat(e, at[:-1])[owner]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(x / 2)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
    p = {k: (r.standard_normal(s) * (0.3 if k == "W" else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
    return p | {"b": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)}


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray):
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # A bag's score does not depend on the other bags of the batch, not even in its last bit.
    h = np.tanh(rowwise(x, p["W"]) + p["b"])
    t, g = np.tanh(rowwise(h, p["V"])), _sigmoid(rowwise(h, p["U"]))
    a = _softmax((t * g * p["w"]).sum(axis=1), at, owner)
    z = np.add.reduceat(a[:, None] * h, at[:-1])
    return (z * p["c"]).sum(axis=1) + p["d"][0], (owner, h, t, g, a, z)


def gradients(p, x, at, y):
    """Loss gradient of a batch of bags (mean logistic loss)."""
    logit, (owner, h, t, g, a, z) = forward(p, x, at)
    e = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    dz = e[:, None] * p["c"]
    da = (dz[owner] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, at[:-1])[owner])
    dh = a[:, None] * dz[owner]
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    dh += dt @ p["V"].T + dg @ p["U"].T
    dh *= 1 - h * h
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ e, "d": e.sum(keepdims=True)}


def train(texts: list[str], y: list[int], epochs: int = 12, batch: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned from texts and their labels; without both classes, a constant by the share of ones."""
    p = initial(seed)
    target = np.array(y, np.float32)
    if not len(y) or target.min() == target.max():
        p["c"][:] = 0
        p["d"][:] = np.log((target.sum() + 1) / (len(y) - target.sum() + 1))
        return p
    column = pa.array(texts, pa.string())
    parts = []
    for lo, hi in text_chunks(column):
        features, bounds = passage_features(column.slice(lo, hi - lo))
        parts.append((features.astype(np.float16), bounds))  # all values are between 0 and 3
    x = np.concatenate([p for p, _ in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            sizes = at[pick + 1] - at[pick]
            rows = np.concatenate([np.arange(at[d], at[d + 1]) for d in pick])
            sub = np.zeros(len(pick) + 1, np.int64)
            np.cumsum(sizes, out=sub[1:])
            g = gradients(p, x[rows].astype(np.float32), sub, target[pick])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] = p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-7) - 1e-5 * p[k]
    return {k: a.astype(np.float32) for k, a in p.items()}


def score_column(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """Scores of whole texts, in order."""
    out = [np.zeros(0)]
    for lo, hi in text_chunks(column):
        x, at = passage_features(column.slice(lo, hi - lo))
        out.append(_sigmoid(forward(p, x, at)[0].astype(np.float64)))
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> dict[str, np.ndarray]:
    """Train on the labelled documents whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``."""
    tune(docs.sparkSession)
    rows = training_sample(docs, labels, "quality", modulus, held_out, PER_CLASS, MAX_BYTES)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    model["d"] = model["d"] + np.float32(class_shift(labels, "quality", modulus, held_out, [y for _, _, y in rows]))
    release_memory()
    return model


def with_scores(docs: DataFrame, model: dict[str, np.ndarray], scorer=score_column, column: str = "score") -> DataFrame:
    """``docs`` (all columns, any order of rows) with the score of its text added as ``column``."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])
    at = [c.lower() for c in kept.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(model, batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return kept.mapInArrow(in_task(run), schema)
