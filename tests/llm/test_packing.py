import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing as P
from tallyspark.llm import tokens

from .corpus import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library():
    bpe = tokens.load(PATH)
    odd = ["", " ", "a<|endoftext|>b", "é　ñ 12,3!!\n\n  x", "\u0000­", "😀 ok", "A" * 3000]
    for text in [x[1] for x in corpus()][:40] + odd:
        assert bpe.ids(text or "").tolist() == reference_ids(text)


def least_cost(at, penalty, total, window):
    """All-pairs dynamic program."""
    pos, pen = [0, *at], [0, *penalty]
    best = [0.0] + [float("inf")] * len(at)
    for j in range(1, len(pos)):
        for i in range(j):
            if 0 < pos[j] - pos[i] <= window:
                best[j] = min(best[j], best[i] + window - (pos[j] - pos[i]) + pen[j])
    return best[-1]


def cost(stops, at, penalty, window):
    pen, before, out = dict(zip(at, penalty, strict=True)), 0, 0
    for s in stops:
        assert 0 < s - before <= window
        out += window - (s - before) + pen[s]
        before = s
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    r = np.random.default_rng(seed)
    at = np.cumsum(r.integers(1, 30, 80)).tolist()
    penalty = r.choice([0, 4, 16], 80).tolist()
    penalty[-1] = 0
    stops = P.cuts(at, penalty, at[-1], 64, True)
    assert cost(stops, at, penalty, 64) == least_cost(at, penalty, at[-1], 64)


def test_candidates_bound_every_stretch():
    ids = np.zeros(1000, "<u4")
    at, penalty = P.candidates(ids, np.array([300, 301, 1000]), np.zeros(4, bool))
    assert np.diff(np.concatenate([[0], at])).max() <= P.GRID and set(at[penalty == 0]) == {300, 301, 1000}


def test_packing_round_trip(spark):
    rows = corpus()
    pieces = P.pack(frame(spark, rows), PATH).collect()
    sequences: dict[int, list] = {}
    texts: dict = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) and p.doc_tokens >= p.start + len(ids)
        sequences.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
        texts.setdefault(p.doc_id, []).append((p.sequence_id, p.offset, p.start, ids))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= P.WINDOW
    want: dict = {}
    for x in rows:
        want.setdefault(x[0], []).append([*reference_ids(x[1]), P.END_ID])
    got = {}
    for doc, parts in texts.items():
        docs: list[list[int]] = []
        for _, _, start, ids in sorted(parts, key=lambda p: p[:2]):
            if start == 0:
                docs.append([])
            assert start == len(docs[-1])
            docs[-1] += ids.tolist()
        got[doc] = docs
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_padding_is_small():
    r = np.random.default_rng(0)
    ends = np.zeros(100, bool)
    ends[:4] = True
    packer, out = P.Packer(ends, 0), []
    for i in range(3000):
        out += packer.add(i, r.integers(0, 100, r.integers(1, 900)).astype("<u4"))
    out += packer.solve(True)
    total = sum(len(p[2]) for p in out)
    assert total / (P.WINDOW * len({p[4] for p in out})) > 0.99


def test_empty_table(spark):
    assert P.pack(frame(spark, []), PATH).count() == 0
