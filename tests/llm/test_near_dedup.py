import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import near_dedup as N
from tallyspark.llm import shingles as S
from tallyspark.llm.common import components

from .corpus import corpus, frame, near_components, shingles


def test_shingle_hashes_follow_the_word_rule():
    rows = [t[1] for t in corpus()]
    for k in (1, 2, 5):
        got = [len(s) for part in S.shingle_sets(pa.array(rows), k) for s in part]
        assert got == [len(shingles(t, k)) for t in rows]


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    text = pa.array([" ".join(f"w{i % 97}" for i in range(5000))])
    whole, _ = S.words(text)
    monkeypatch.setattr(S, "STRETCH", 64)
    cut, _ = S.words(text)
    assert (whole == cut).all()


@pytest.mark.parametrize("n", [1, 2, 5, 40, 3000])
def test_sketch_fills_every_bin_and_estimates_jaccard(n):
    r = np.random.default_rng(n)
    common = r.integers(0, 1 << 63, n, dtype=np.uint64)
    a, b = common, np.concatenate([common, r.integers(0, 1 << 63, n // 2, dtype=np.uint64)])
    x = N.sketches([a, b])
    assert (x != (1 << 64) - 1).all()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x[0] == x[1]).mean() - truth) < 0.11


def test_link_forest_equals_all_pairs():
    r = random.Random(3)
    base = list(range(100))
    sets = []
    for _ in range(60):
        s = set(base)
        for _ in range(r.randint(0, 25)):
            s.discard(r.choice(base))
            s.add(r.randrange(1000, 9000))
        sets.append(np.array(sorted(s), np.uint64))
    forest = N.link_forest(sets, np.zeros(60, int), Fraction(4, 5))
    label = list(range(60))

    def join(pairs):
        out = label[:]
        for i, j in pairs:
            a, b = out[i], out[j]
            out = [min(a, b) if x in (a, b) else x for x in out]
        return out

    pairs = [(i, j) for i in range(60) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert join(forest) == join(pairs) and len(forest) < 60


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 4)  # crowds span several blocks
    rows = corpus()
    got = N.near_duplicate_groups(frame(spark, rows), k).collect()
    want = near_components(rows, k)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    size = {x[0]: len(shingles(x[1], k)) for x in rows if x[0] is not None}
    assert all(r.n_shingles == size[r.doc_id] for r in got if r.doc_id is not None)


def test_deduplicate_keeps_one_row_of_each_group(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = N.deduplicate(df, 5)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    want = near_components(rows, 5)
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c})
    assert ids.count(None) == 2


def test_versions_of_one_doc_id_are_one_document(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = corpus()[:0] + [(1, a), (2, b), (3, a), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in N.near_duplicate_groups(df, 2).collect()} == {1}
    assert [r.doc_id for r in N.deduplicate(df, 2).collect()] == [1]


def test_empty_table(spark):
    df = frame(spark, [])
    assert N.near_duplicate_groups(df, 2).count() == 0 and N.deduplicate(df).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(300, 400)] + [(7, 7)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(x, 5) for x in (5, *range(300, 400))}


def test_a_crowd_meets_its_head_first(spark, monkeypatch):
    """Near copies of one text, a few that only near copies resemble, and others: about two text rows a member."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]

    def changed(words, n):
        out = list(words)
        for i in r.sample(range(60), n):
            out[i] = f"z{r.randrange(10**9)}"
        return out

    crowd = [base] + [changed(base, 1) for _ in range(300)]
    crowd += [changed(w, 2) for w in crowd[1:8]]  # further from the base than from what they copy
    rows = [(i, " ".join(w)) for i, w in enumerate(crowd)] + [(900 + i, f"alone {i} here") for i in range(5)]
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 32)
    sizes, write = {}, N.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(N, "written", counted)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.component_id for x in N.near_duplicate_groups(df, 2).collect()}
    want = near_components([(i, t) for i, t in rows], 2)
    assert got == want and len(set(want.values())) < 20
    assert sizes["near-star"] + sizes["near-tile"] <= 2.5 * len(crowd)
