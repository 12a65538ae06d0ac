import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tallyspark.llm import token_counts as K
from tallyspark.llm.common import shared_path

from .corpus import corpus, frame, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_counts_of_whole_texts(spark):
    rows = corpus()
    bpe = Tokenizer.from_file(PATH)
    got = sorted(tuple(r) for r in K.counted(frame(spark, rows), PATH).select("words", "runs", "bpe").collect())
    runs = [len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (x[1] or "").encode())) for x in rows]
    want = [(len(words(x[1])), n, len(bpe.encode(x[1] or "", add_special_tokens=False).ids)) for x, n in zip(rows, runs, strict=True)]
    assert got == sorted(want)


def test_signed_batches_equal_a_recount(spark):
    rows = K.counted(frame(spark, corpus()), PATH).cache()
    rollup = K.Rollup(spark, shared_path(spark, "rollup-test"))
    assert totals(rollup) == {}
    assert rollup.apply("a", K.inserts(rows, "words", "w1"))
    gone = rows.where("doc_id % 2 = 0")
    assert rollup.apply("b", K.deletes(gone, "words", "w1"))
    left = rows.where("doc_id % 2 = 1 or doc_id is null")
    revised = left.where("source = 's0'")
    assert rollup.apply("c", K.revisions(revised, "words", "w1", "bpe", "bpe"))
    documents, tokens = Counter(), Counter()
    for r in left.collect():
        key = (r.source, r.lang, "bpe" if r.source == "s0" else "w1")
        documents[key] += 1
        tokens[key] += r.bpe if r.source == "s0" else r.words
    want = {k: (documents[k], tokens[k]) for k in documents}
    assert totals(rollup) == want
    # A batch that comes again changes nothing, before and after a compaction.
    assert not rollup.apply("b", K.deletes(gone, "words", "w1"))
    assert rollup.compact() and not rollup.compact()
    assert totals(rollup) == want
    assert not rollup.apply("a", K.inserts(rows, "words", "w1")) and totals(rollup) == want
    assert rollup.apply("d", K.deletes(revised, "bpe", "bpe"))
    assert totals(rollup) == {k: v for k, v in want.items() if k[2] == "w1"}


def test_uncommitted_attempts_do_not_count(spark):
    rows = K.counted(frame(spark, corpus()), PATH)
    rollup = K.Rollup(spark, shared_path(spark, "rollup-test"))
    rollup.apply("a", K.inserts(rows, "words", "w1"))
    before = totals(rollup)
    # Deltas of an attempt that lost the race for its commit.
    assert not rollup._commit("a", K.inserts(rows, "words", "w1"))
    assert totals(rollup) == before


def test_empty_and_null_batches(spark):
    rows = K.counted(frame(spark, corpus()), PATH)
    rollup = K.Rollup(spark, shared_path(spark, "rollup-test"))
    assert rollup.apply("none", K.inserts(rows.limit(0), "words", "w1")) and totals(rollup) == {}
    df = spark.createDataFrame([(None, None, None), ("s", "en", 4)], "source string, lang string, n int")
    assert rollup.apply("nulls", K.inserts(df, "n", None))
    assert totals(rollup) == {(None, None, None): (1, 0), ("s", "en", None): (1, 4)}


CHANGES = "source string, lang string, n int"


def test_a_commit_that_did_not_finish_does_not_block_its_batch(spark):
    path = shared_path(spark, "rollup-test")
    rollup = K.Rollup(spark, path)
    changes = K.inserts(spark.createDataFrame([("s", "en", 4)], CHANGES), "n", "v")
    # What a driver leaves that dies in the commit's write: a folder without rows, under the batch's or any name.
    for name in ("a", "0" * 32):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{name}/_temporary")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    assert not rollup.committed("a") and totals(rollup) == {}
    assert rollup.apply("a", changes) and totals(rollup) == {("s", "en", "v"): (1, 4)}
    assert not rollup.apply("a", changes) and totals(rollup) == {("s", "en", "v"): (1, 4)}


def test_a_commit_row_of_an_unfinished_write_does_not_count(spark):
    path = shared_path(spark, "rollup-test")
    rollup = K.Rollup(spark, path)
    changes = K.inserts(spark.createDataFrame([("s", "en", 4)], CHANGES), "n", "v")
    assert rollup.apply("a", changes)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/*/_SUCCESS")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.globStatus(fs_path):
        fs.delete(s.getPath(), False)
    assert totals(rollup) == {}
    assert rollup.apply("a", changes) and totals(rollup) == {("s", "en", "v"): (1, 4)}


def test_two_drivers_that_commit_one_batch_count_once(spark, monkeypatch):
    path = shared_path(spark, "rollup-test")
    one, two = K.Rollup(spark, path), K.Rollup(spark, path)
    changes = K.inserts(spark.createDataFrame([("s", "en", 4), ("t", "en", 2)], CHANGES), "n", "v")
    want = {("s", "en", "v"): (1, 4), ("t", "en", "v"): (1, 2)}
    # Both look before either has committed, and neither write fails.
    for r in (one, two):
        monkeypatch.setattr(r, "committed", lambda b: False)
        r.apply("a", changes)
    assert spark.read.schema(K._COMMITS).parquet(f"{path}/commits/*").count() == 2
    assert totals(one) == totals(two) == want
    assert one.apply("b", changes) and one.compact()
    assert totals(two) == {k: (2 * d, 2 * n) for k, (d, n) in want.items()}


def test_a_commit_during_a_compaction_counts_once(spark, monkeypatch):
    rollup = K.Rollup(spark, shared_path(spark, "rollup-test"))
    for name, n in (("a", 1), ("b", 10)):
        rollup.apply(name, K.inserts(spark.createDataFrame([("s", "en", n)], CHANGES), "n", "v"))
    real = K.Rollup._sums

    def meanwhile(self, live):  # between the listing of a compaction and its sums
        monkeypatch.setattr(K.Rollup, "_sums", real)
        self.apply("c", K.inserts(spark.createDataFrame([("s", "en", 100)], CHANGES), "n", "v"))
        return real(self, live)

    monkeypatch.setattr(K.Rollup, "_sums", meanwhile)
    assert rollup.compact()
    assert totals(rollup) == {("s", "en", "v"): (3, 111)}
    assert rollup.compact() and totals(rollup) == {("s", "en", "v"): (3, 111)}
    # What is folded is removed: one commit and one delta are left, and old batches still count once.
    assert len(K.finished_paths(spark, f"{rollup.path}/commits")) == len(K.finished_paths(spark, f"{rollup.path}/deltas")) == 1
    assert not any(rollup.apply(b, K.inserts(spark.createDataFrame([("s", "en", 5)], CHANGES), "n", "v")) for b in "abc")
