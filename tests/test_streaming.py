"""Streaming: AvailableNow runs over landing batches equal the batch ingest;
live bucket totals de-duplicate ids within the watermark."""

import json
import os

from tallyspark.plans.ingest import UsageStore, ingest, read_usage
from tallyspark.streaming import live as L


def line(mid, ts, out):
    return json.dumps({"type": "assistant", "sessionId": "s", "timestamp": ts,
                       "message": {"id": mid, "model": "m-1", "usage": {"output_tokens": out}}})


def land(root, name, lines):
    os.makedirs(f"{root}/-p", exist_ok=True)
    with open(f"{root}/-p/{name}", "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_available_now_equals_batch(spark, tmp_dir):
    landing, store = f"{tmp_dir}/landing", UsageStore(f"{tmp_dir}/store")
    ckpt = L.checkpoint_path(store, "ingest")
    land(landing, "a.jsonl", [line("1", "2024-01-01T00:10:00Z", 1), line("2", "2024-01-01T01:10:00Z", 2)])
    L.stream_ingest(spark, landing, store, ckpt).awaitTermination()
    # Second landing batch repeats id 2 (re-delivery) and adds id 3.
    land(landing, "b.jsonl", [line("2", "2024-01-01T01:10:00Z", 99), line("3", "2024-01-01T02:10:00Z", 3)])
    L.stream_ingest(spark, landing, store, ckpt).awaitTermination()
    L.stream_ingest(spark, landing, store, ckpt).awaitTermination()  # nothing new

    batch_store = UsageStore(f"{tmp_dir}/batch")
    ingest(spark, landing, batch_store)
    cols = ["message_id", "output_tokens", "ts"]
    s = sorted(tuple(r) for r in read_usage(spark, store).select(*cols).collect())
    b = sorted(tuple(r) for r in read_usage(spark, batch_store).select(*cols).collect())
    assert s == b and [r[1] for r in s] == [1, 2, 3]


def test_live_bucket_totals(spark, tmp_dir):
    landing = f"{tmp_dir}/landing"
    land(landing, "a.jsonl", [line("1", "2024-01-01T00:10:00Z", 1), line("2", "2024-01-01T00:20:00Z", 2),
                              line("2", "2024-01-01T00:20:00Z", 2), line("3", "2024-01-01T01:05:00Z", 4)])
    usage = L.parsed_usage_stream(L.landing_stream(spark, landing))
    totals = L.live_bucket_totals(usage, "hour", "2 hours")
    q = (totals.writeStream.format("memory").queryName("live_totals").outputMode("update")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {r.bucket: r.output_tokens for r in spark.sql("select * from live_totals").collect()}
    assert rows == {"2024-01-01 00:00:00": 3, "2024-01-01 01:00:00": 4}


def test_periodic_reconcile_trigger(spark, tmp_dir):
    landing, store = f"{tmp_dir}/landing", UsageStore(f"{tmp_dir}/store")
    land(landing, "a.jsonl", [line("p1", "2024-01-01T00:10:00Z", 1)])
    q = L.stream_ingest(spark, landing, store, L.checkpoint_path(store, "periodic"),
                        available_now=False, interval="1 second")
    try:
        q.processAllAvailable()
        land(landing, "b.jsonl", [line("p2", "2024-01-01T00:20:00Z", 2), line("p1", "2024-01-01T00:10:00Z", 9)])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.message_id: r.output_tokens for r in read_usage(spark, store).collect()}
    assert got == {"p1": 1, "p2": 2}  # the re-delivered p1 is ignored
