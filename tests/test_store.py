"""The stored ids, the intents of interrupted runs, and the live totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import ingest as I
from tallyspark.plans.totals import MEASURES, TotalsLog, deltas
from tallyspark.schemas import USAGE

from test_ranges import line, put


def facts(spark, ids, day=1, tokens=1):
    ts = dt.datetime(2024, 1, day, 5)
    rows = [(str(i), None, "s", "p", None, None, "m-1", ts, tokens, 0, 0, 0, "f", 1, "p", ts.date()) for i in ids]
    return spark.createDataFrame(rows, USAGE)


def totals(spark, store):
    got = {(str(r.usage_date), r.bucket): (r.messages, r.input_tokens) for r in I.live_totals(spark, store).collect()}
    u = I.read_usage(spark, store).groupBy("usage_date", F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("b"))
    want = {(str(r.usage_date), r.b): (r.n, r.t) for r in u.agg(F.count("*").alias("n"), F.sum("input_tokens").alias("t")).collect()}
    assert got == want
    return got


def insert(spark, store, rows):
    I.recover(spark, store)
    path = f"{store.intents}/insert-{rows.first().message_id}-{rows.count()}"
    I.drop_known(spark, store, rows).select(*[f.name for f in USAGE.fields]).write.parquet(path)
    return path


def test_stored_ids_are_not_shuffled_and_few_are_read(spark, tmp_dir):
    store = I.UsageStore(f"{tmp_dir}/store", id_buckets=16)
    I._apply_insert(spark, store, insert(spark, store, facts(spark, range(3000))), again=False)
    ids = I.stored_ids(spark, store)
    small = I.staged(facts(spark, [5, 99999]), "t")
    found = I.among_stored(ids, small)
    assert [r.message_id for r in found.collect()] == ["5"]
    assert "Exchange" not in found._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition a file
    try:
        assert found.rdd.getNumPartitions() <= 2 < ids.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    large = I.staged(facts(spark, range(1500, 4500)), "t")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = I.among_stored(ids, large)
        plan = found._jdf.queryExecution().toString()
        # One exchange, and it is the batch's.
        physical = plan.split("== Physical Plan ==")[1]
        assert physical.count("Exchange hashpartitioning(message_id") == 1 and found.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert I.drop_known(spark, store, large).count() == 1500
    I.compact_ids(spark, store)
    assert I.stored_ids(spark, store).count() == 3000


def test_a_store_without_ids_gets_them(spark, tmp_dir):
    store = I.UsageStore(f"{tmp_dir}/store")
    facts(spark, [1, 2]).write.partitionBy("usage_date").parquet(store.usage)
    I.delete_records(spark, store, spark.createDataFrame([("2",), ("8",)], "message_id string"))
    assert {r.message_id for r in I.stored_ids(spark, store).collect()} == {"1", "2", "8"}
    assert [r.message_id for r in I.drop_known(spark, store, facts(spark, [1, 2, 3, 8])).collect()] == ["3"]


@pytest.mark.parametrize("stop", ["append_usage", "append_ids", "TotalsLog", "delete_path"])
def test_interrupted_inserts_are_finished(spark, tmp_dir, monkeypatch, stop):
    store = I.UsageStore(f"{tmp_dir}/store")
    I._apply_insert(spark, store, insert(spark, store, facts(spark, [1, 2])), again=False)

    def dies(*a, **k):
        raise RuntimeError("lost driver")

    path = insert(spark, store, facts(spark, [2, 3, 4], day=2, tokens=7))
    with monkeypatch.context() as m:
        m.setattr(I, stop, dies)
        with pytest.raises(RuntimeError):
            I._apply_insert(spark, store, path, again=False)
    assert I.recover(spark, store) == 1 and I.recover(spark, store) == 0
    assert sorted(r.message_id for r in I.read_usage(spark, store).collect()) == ["1", "2", "3", "4"]
    assert totals(spark, store) == {("2024-01-01", "2024-01-01 05:00:00"): (2, 2), ("2024-01-02", "2024-01-02 05:00:00"): (2, 14)}


@pytest.mark.parametrize("stop", ["append_ids", "TotalsLog", "delete_path"])
def test_interrupted_deletes_are_finished(spark, tmp_dir, monkeypatch, stop):
    store = I.UsageStore(f"{tmp_dir}/store")
    I._apply_insert(spark, store, insert(spark, store, facts(spark, range(10))), again=False)
    real = getattr(I, stop)
    state = {"armed": True}

    def dies(*a, **k):
        if state["armed"] and (stop != "delete_path" or "/_intents/" in a[1]):
            raise RuntimeError("lost driver")
        return real(*a, **k)

    with monkeypatch.context() as m:
        m.setattr(I, stop, dies)
        with pytest.raises(RuntimeError):
            I.delete_records(spark, store, spark.createDataFrame([("3",), ("77",)], "message_id string"))
        state["armed"] = False
    I.recover(spark, store)
    assert totals(spark, store) == {("2024-01-01", "2024-01-01 05:00:00"): (9, 9)}
    I.delete_records(spark, store, spark.createDataFrame([("3",)], "message_id string"))  # twice changes nothing
    assert totals(spark, store) == {("2024-01-01", "2024-01-01 05:00:00"): (9, 9)}


def test_deletes_late_rows_and_compaction_keep_totals_true(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", I.UsageStore(f"{tmp_dir}/store")
    put(f"{root}/-p/a.jsonl", "".join(line(i) + "\n" for i in range(20)))
    I.ingest(spark, root, store)
    I._apply_insert(spark, store, insert(spark, store, facts(spark, ["late"], day=3)), again=False)
    I.delete_records(spark, store, I.read_usage(spark, store).where("usage_date = '2024-01-03' or message_id = 'm4'"))
    assert len(totals(spark, store)) == 1  # the day that lost every row is gone
    assert I.compact(spark, store) == 2
    put(f"{root}/-p/a.jsonl", line(30) + "\n", "a")
    I.ingest(spark, root, store)
    assert totals(spark, store)[("2024-01-01", "2024-01-01 00:00:00")][0] == 20
    day = I.live_totals(spark, store, "day").collect()
    assert [(r.bucket, r.messages) for r in day] == [("2024-01-01", 20)]


def test_compaction_of_totals_loses_no_commit_and_counts_none_twice(spark, tmp_dir, monkeypatch):
    log = TotalsLog(spark, f"{tmp_dir}/totals")
    rows = [deltas(facts(spark, range(n)), 1) for n in (1, 10, 100)]
    log.commit("a", rows[0])
    log.commit("b", rows[1])
    log.commit("b", rows[1])  # counts once
    rows[1].write.parquet(f"{log._commits}/b~zz")  # a second finished attempt
    real = TotalsLog._rows

    def meanwhile(self, attempts):  # a commit between the two reads of a compaction
        monkeypatch.setattr(TotalsLog, "_rows", real)
        self.commit("c", rows[2])
        return real(self, attempts)

    monkeypatch.setattr(TotalsLog, "_rows", meanwhile)
    assert log.compact() == 2
    assert log.totals().first().messages == 111
    assert log.compact() == 1 and log.compact() == 0 and log.totals().first().messages == 111
    log.commit("a", rows[0])  # folded long ago
    assert log.totals().first().messages == 111
    assert set(MEASURES) <= set(log.totals().columns)
