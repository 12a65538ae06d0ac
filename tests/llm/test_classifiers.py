import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import labels, quality, toxicity

from .corpus import corpus, crc, frame, row, sentence

LABELS = "doc_id long, quality int, toxic int, score string"


def labelled(seed=3, n=700):
    """Bad quality: symbols after every word; toxic: a known word or a stem somewhere in a long text."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = sentence(r, r.randint(20, 260)).split(" ")
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zonk", "grubble", "kweltu" + r.choice("abcdefgh")])
        if bad:
            w = [x + r.choice(["***", "%%%"]) for x in w]
        rows.append(row(i, " ".join(w)))
        marks.append((i, int(not bad), int(toxic), "x"))
    return rows, marks


def numeric_gradient(loss, p, g, eps=1e-5):
    r = np.random.default_rng(0)
    for k in p:
        flat, grad = p[k].reshape(-1), g[k].reshape(-1)
        at = r.choice(np.flatnonzero(grad)) if grad.any() else 0
        kept = flat[at]
        flat[at] = kept + eps
        up = loss()
        flat[at] = kept - eps
        down = loss()
        flat[at] = kept
        assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-8), k


def test_quality_gradients():
    p = {k: v.astype(np.float64) for k, v in quality.initial().items()}
    x, at, y = np.random.default_rng(1).random((7, quality.FEATURES)), np.array([0, 3, 7]), np.array([1.0, 0.0])

    def loss():
        z = quality.forward(p, x, at)[0]
        return np.mean(np.logaddexp(0, z) - y * z)

    numeric_gradient(loss, p, quality.gradients(p, x, at, y))


def test_toxicity_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    tokens = toxicity.Tokens(pa.array(["the zonk is here, andaverylongwordthatisinpieces yes", "kweltu abc"]))
    ids, _ = tokens.windows()
    y = np.array([1.0, 0.0])

    def loss():
        z = toxicity.window_logits(p, toxicity.token_inputs(p, tokens), ids)
        return np.mean(np.logaddexp(0, z) - y * z)

    numeric_gradient(loss, p, toxicity.gradients(p, tokens, ids, y))


def test_windows_cover_whole_texts():
    texts = [None, "", "a", " ".join("w%d" % i for i in range(500)), "é" * 100]
    tokens = toxicity.Tokens(pa.array(texts))
    ids, at = tokens.windows()
    n = np.diff(tokens.bounds)
    assert n.tolist() == [0, 0, 1, 500, 9]
    for d in range(len(texts)):
        seen = ids[at[d] : at[d + 1]]
        sequence = tokens.sequence[tokens.bounds[d] : tokens.bounds[d + 1]]
        assert set(seen[seen >= 0].tolist()) == set(sequence.tolist())
    # Every window but the last is full, and starts a stride after the one before.
    assert (ids[at[3] : at[4] - 1] >= 0).all()


def test_chunks_do_not_change_scores(monkeypatch):
    texts = pa.array([x[1] for x in corpus()])
    for module, name in ((quality, "passage_features"), (toxicity, "Tokens")):
        model = module.initial()
        whole = module.score_column(model, texts)
        monkeypatch.setattr(toxicity, "CHUNK", 500)
        monkeypatch.setattr(toxicity, "SLICE", 7)
        assert np.allclose(whole, module.score_column(model, texts), atol=1e-5), name
        assert len(whole) == len(texts) and ((whole >= 0) & (whole <= 1)).all()


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, module, label, modulus, held, least):
    rows, marks = labelled()
    docs, lab = frame(spark, rows), spark.createDataFrame(marks, LABELS)
    model = module.fit(docs, lab, modulus, held)
    scored = quality.with_scores(docs, model, module.score_column).collect()
    score = {r.doc_id: r.score for r in scored}
    truth = {m[0]: m[1 if label == "quality" else 2] for m in marks}
    out = [i for i in truth if crc(str(i)) % modulus == held]
    assert len(out) > 100
    assert np.mean([(score[i] >= 0.5) == truth[i] for i in out]) >= least


def test_sample_leaves_out_the_held_out_fold_and_is_bounded(spark):
    rows, marks = labelled(n=300)
    marks += [(None, 1, 1, ""), (5, None, None, ""), (100_000, 1, 1, ""), (6, 7, 7, "")]
    rows += [row(100_000, "long " * 100)]
    docs, lab = frame(spark, rows), spark.createDataFrame(marks, LABELS)
    got = labels.training_sample(docs, lab, "quality", 3, 1, 20, 400_000)
    assert [y for *_, y in got].count(1) == 20 and [y for *_, y in got].count(0) == 20
    assert all(crc(str(i)) % 3 != 1 for i, *_ in got)
    assert got == labels.training_sample(docs.repartition(3), lab.repartition(2), "quality", 3, 1, 20, 400_000)
    assert all(len(t) <= 300 for _, t, _ in labels.training_sample(docs, lab, "quality", 3, 1, 200, 300))


def test_labels_lang_source_and_doc_id_are_no_inputs(spark):
    rows, marks = labelled(n=120)
    docs = frame(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(marks, LABELS))
    other = docs.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    a = {r.text: r.score for r in quality.with_scores(docs, model).collect()}
    b = {r.text: r.score for r in quality.with_scores(other, model).collect()}
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_tables(spark, module):
    rows = corpus()
    docs = frame(spark, rows)
    none = spark.createDataFrame([], LABELS)
    model = module.fit(docs, none)
    out = quality.with_scores(docs, model, module.score_column).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    empty = quality.with_scores(frame(spark, []), module.initial(), module.score_column)
    assert empty.count() == 0 and empty.columns == [c for c in docs.columns if c != "score"] + ["score"]
    held = docs.select(labels.is_held_out(5, 0).alias("h"), "doc_id").collect()
    assert all(r.h == (r.doc_id is not None and crc(str(r.doc_id)) % 5 == 0) for r in held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_a_score_is_a_function_of_the_text_alone(module):
    r = np.random.default_rng(3)
    model = {k: (a + r.normal(0, 0.3, a.shape)).astype(np.float32) for k, a in module.initial().items()}
    texts = [x[1] for x in corpus(n=120)]
    together = module.score_column(model, pa.array(texts))
    turned = module.score_column(model, pa.array(texts[::-1]))[::-1]
    alone = np.concatenate([module.score_column(model, pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all() and (together == turned).all()
    assert len(np.unique(together)) > 100
