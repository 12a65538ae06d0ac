import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score string, block int, Row int"


def vectors(n=900, d=12):
    r = np.random.default_rng(6)
    heads = r.normal(0, 0.3, (12, d))
    x = (heads[r.integers(0, 12, n)] + r.normal(0, 0.1, (n, d))).astype(np.float32)
    label = r.integers(0, 4, n)
    label[200:500] = 2  # a hot label
    x[250:400] = x[250]  # a crowd of equal vectors
    x[600:610] = 0
    rows = [(int(i), int(a), [float(c) for c in v], "s", 1, 2) for i, (v, a) in enumerate(zip(x, label, strict=True))]
    rows[3] = (3, 1, None, "s", 1, 2)
    rows[4] = (4, None, rows[4][2], "s", 1, 2)
    rows[5] = (5, 1, [0.5, None], "s", 1, 2)
    rows[6] = (6, 1, [float("nan")] * d, "s", 1, 2)
    rows[8] = (8, 2, [0.9, -0.3], "s", 1, 2)
    rows[9] = (9, 2, [], "s", 1, 2)
    rows[10] = (10, 0, [4.0] * d, "s", 1, 2)
    rows += [rows[20], rows[21], rows[300], rows[300], (None, 1, rows[20][2], "s", 1, 2)]  # repeated rows
    rows += [(20, 3, rows[30][2], "s", 1, 2), (40, 2, [-1.0] * d, "s", 1, 2)]  # one id, other rows; negative scores
    return rows


def brute(rows, every):
    q = [
        (i, a, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, a, v, *_ in rows
        if i is not None and a is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for n, (i, a, v) in enumerate(q):
        if i % every == 0:
            score = [(sum(x * y for x, y in zip(v, w, strict=False)), j, b) for m, (j, b, w) in enumerate(q) if m != n]
            for p, j in sorted((-s, j) for s, j, b in score if b == a)[:5]:
                fits = sorted((-s, t) for s, t, b in score if b != a and 80 * -p <= 100 * s <= 100 * -p)[:5]
                out += [(i, j, m + 1, t, -p, -s) for m, (s, t) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("block", "leaf", "labels"), [(8192, 32, 64), (100, 8, 2), (40, 1, 64)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, leaf, labels):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "LABELS", labels)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, 20)


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 1, [1.0], "", 0, 0), (1, 1, [1.0], "", 0, 0), (2, 0, [0.9], "", 0, 0)], SCHEMA)
    got = [tuple(r) for r in H.hard_negatives(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 230 * 256)]
    assert H.hard_negatives(df, F.col("vec_id") == 9).count() == 0
    assert H.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_tree_covers_separates_and_prunes():
    r = np.random.default_rng(3)
    points = np.floor(np.repeat(r.normal(0, 100, (30, 8)), 100, 0) + r.normal(0, 3, (3000, 8))).astype(np.int64)
    longest = float((points.astype(float) ** 2).sum(1).max())
    order, levels, centres = H.CoverTree.build(H.augmented(points, longest))
    x = H.augmented(points[order], longest)
    assert sorted(order) == list(range(3000))
    for depth, (nodes, heads) in enumerate(zip(levels, centres, strict=True)):
        for node, head in zip(nodes, heads, strict=True):
            assert node["lo"] <= head < node["hi"]
            assert H._distances(x[node["lo"] : node["hi"]], x[head]).max() <= node["radius"] + 1e-6
            if node["children"]:
                below = slice(node["child"], node["child"] + node["children"])
                kids, at = levels[depth + 1][below], centres[depth + 1][below]
                assert kids["lo"][0] == node["lo"] and kids["hi"][-1] == node["hi"] and head in at
                apart = [H._distances(x[at], x[c]) for c in at]
                assert all(sorted(d)[1] > node["radius"] / H.BASE for d in apart if len(d) > 1)
    block = H.Block(np.arange(3000), order, np.zeros(3000, int), points[order], H.CoverTree(levels, centres), longest)
    verified = []
    block.points = np.asarray(block.points).view(Counted)
    Counted.seen = verified
    q = points[:5]
    found, place, score = block.search(np.full(5, -1), np.zeros(5, int), q, np.arange(5), np.full(5, H.LOWEST + 1), np.full(5, -H.LOWEST), True, 5)
    exact = q @ points.T
    for i in range(5):
        want = sorted(((-s, j) for j, s in enumerate(exact[i])))[:5]
        assert [(-int(s), int(order[p])) for f, p, s in zip(found, place, score, strict=True) if f == i] == want
    assert sum(verified) < 3000


class Counted(np.ndarray):
    """Counts the rows that are sliced out for verification."""

    seen: list[int] = []

    def __getitem__(self, key):
        if isinstance(key, slice):
            Counted.seen.append(key.stop - key.start)
        return np.asarray(super().__getitem__(key))
