import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import repeats as R

from .corpus import DOCS, corpus, row, sentence


def documents():
    r = random.Random(5)
    rows = corpus(n=40)
    passage, line = sentence(r, 60), "A line that many documents share, with a tail of some more words to be long."
    rows += [row(500 + i, f"{sentence(r, 9)} {passage if i % 2 else line} {sentence(r, 12)}") for i in range(30)]
    rows += [row(600, "a" * 5000), row(601, "ab" * 700 + "é" * 300), row(602, "a" * 99), row(603, "a" * 100), row(603, "b" * 150)]
    rows += [row(700 + i, "É" * 60 + "x" * i) for i in range(4)]
    return rows


def brute(rows):
    """Every 100-byte string of every row, in order of id, hash of the text (as the operator's), row and start."""
    texts = sorted(((-(1 << 63) if i is None else i), n, i, (t or "").encode()) for n, (i, t, *_) in enumerate(rows))
    seen, out = set(), []
    for _, _, i, data in texts:
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(data[a : a + 100])
        n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"SORTED": 50, "HOT": 8}, {"STRETCH": 700, "BLIND": 2}, {"SHALLOW": 0}])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    rows = documents()
    # Equal texts under one null id differ in nothing; different texts of one id (603) share no string.
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = R.removed(df).drop("spans").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)


def test_spans_are_the_removed_bytes(spark):
    rows = [row(1, "x" * 130), row(2, "y" * 40 + "x" * 110 + "z" * 10), row(3, None), row(4, "")]
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in R.removed(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [(1, 130)], 2: [(40, 150)], 3: [], 4: []}
    assert R.removed(spark.createDataFrame([], DOCS)).count() == 0


def test_blind_trie_orders_like_sorting():
    r = random.Random(2)
    keys = [r.choice([r.getrandbits(80), r.getrandbits(6), 1 << r.randrange(80)]) for _ in range(400)]
    sets = R.blind_sets(keys)
    assert [keys[s[0]] for s in sets] == sorted(set(keys))
    assert all(len({keys[i] for i in s}) == 1 for s in sets) and sorted(i for s in sets for i in s) == list(range(400))


def test_every_string_has_one_anchor_given_by_its_bytes():
    r = random.Random(4)
    text = bytes(r.choice(b"ab") for _ in range(3000)) + b"z" * 400
    data = np.frombuffer(text, np.uint8)
    found, start, n, place = R.anchors(data, np.array([0, 1000, 1050, len(data)]))
    anchor = {}
    for h, s, m, p in zip(found.tolist(), start.tolist(), n.tolist(), place.tolist(), strict=True):
        for j in range(m):
            assert 0 <= p - j < R.SPAN
            assert anchor.setdefault(text[s + j : s + j + 100], (h, p - j)) == (h, p - j)
    assert sum(n) == 901 + len(data) - 1050 - 99
