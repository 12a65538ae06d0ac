import math

import numpy as np
import pytest

from tallyspark.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tile int, V int"


def vectors(n=700, d=16):
    r = np.random.default_rng(8)
    x = r.normal(0, 0.2, (n, d)).astype(np.float32)
    x[100:400] = x[100]  # a crowd of equal vectors
    x[450:460] = 0
    rows = [(int(i), [float(a) for a in v], 0, "s", 1, 2) for i, v in enumerate(x)]
    rows[3] = (3, None, 0, "s", 1, 2)
    rows[4] = (4, [0.5, None] + [0.1] * 14, 0, "s", 1, 2)
    rows[50] = (50, [float("nan")] * d, 0, "s", 1, 2)
    rows[7] = (7, [float("inf")] * d, 0, "s", 1, 2)
    rows[8] = (8, [0.9, -0.3], 0, "s", 1, 2)
    rows[9] = (9, [], 0, "s", 1, 2)
    rows[10] = (10, [30.0] * d, 0, "s", 1, 2)
    return [*rows, (None, [0.1] * d, 0, "s", 1, 2)]


def brute(rows, k):
    q = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v):
            q[i] = [math.floor(256 * float(np.float32(a))) for a in v]
    out = []
    for i, v in q.items():
        if i % 50 == 0:
            hits = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in q.items() if j != i))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries", "k"), [(8192, 512, 5), (64, 4, 5), (100, 3, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, queries, k):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QUERY_BLOCK", queries)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in K.top_k(df, df.where("vec_id % 50 = 0"), k).collect())
    assert got == brute(rows, k)


def test_early_stops_happen_and_stay_exact(monkeypatch):
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 1, (3000, 32)) ** 5 * 40).astype(np.int64)  # heavy tails: few segments decide
    index = K.ImpactIndex(np.arange(3000), K.ImpactIndex.segments_of(x), 32)
    assert (index.vectors == x).all() and [s[0] for s in index.segments] == sorted({s[0] for s in index.segments}, reverse=True)
    read = []
    best = index._best
    monkeypatch.setattr(index, "_best", lambda q, v, members, k: (read.append(len(members)), best(q, v, members, k))[1])
    got = index.top(np.arange(20), x[:20], 5)
    score = (x[:20] @ x.T).astype(float)
    score[np.arange(20), np.arange(20)] = -np.inf
    want = [(q, int(v), int(score[q, v])) for q in range(20) for v in np.lexsort((np.arange(3000), -score[q]))[:5]]
    assert sorted(got) == sorted(want)
    assert max(read) < 3000


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [0.5], 0, "", 0, 0), (1, [0.25], 0, "", 0, 0)], SCHEMA)
    assert [tuple(r) for r in K.top_k(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 128 * 64)]
    none = df.limit(0)
    assert K.top_k(none, none, 5).count() == 0 and K.top_k(df, none, 5).count() == 0


def every_row(rows, k):
    """As the SQL twin: pairs of rows with other ids, the k best a query_id."""
    q = [(i, [math.floor(256 * a) for a in v]) for i, v, *_ in rows]
    out = []
    for i in sorted({i for i, _ in q if i % 50 == 0}):
        hits = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for h, x in q if h == i for j, y in q if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries"), [(8192, 512), (16, 2)])
def test_repeated_rows_and_ids_count_as_the_sql_twin_says(spark, monkeypatch, block, queries):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QUERY_BLOCK", queries)
    r = np.random.default_rng(3)
    x = [(int(i), [float(a) for a in v], 0, "s", 1, 2) for i, v in enumerate(r.normal(0, 0.2, (120, 8)).astype(np.float32))]
    rows = [*x, *[(50, [4.0] * 8, 0, "s", 1, 2)] * 9, *[(50, [a + 5.0 for a in x[7][1]], 0, "s", 1, 2)] * 2]  # a query's own id
    rows += [(100, [3.0 + i] * 8, 0, "s", 1, 2) for i in range(12)]  # its id with other vectors
    rows += [x[33]] * 7 + [(34, [2.0] * 8, 0, "s", 1, 2)] * 3  # candidates
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(t) for t in K.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == every_row(rows, 5)


def test_rows_of_the_query_take_no_place_in_a_block():
    x = np.array([[9]] * 8 + [[5], [4], [3], [2], [1], [6]])
    index = K.ImpactIndex(np.array([0] * 8 + [1, 2, 3, 4, 5, 6]), K.ImpactIndex.segments_of(x), 1)
    assert [t[1] for t in index.top(np.array([0]), x[:1], 5)] == [6, 1, 2, 3, 4]
