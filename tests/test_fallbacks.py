"""The shuffled-join paths used beyond each broadcast bound give the same results."""

import json
import os

import pytest

from tallyspark.operators.rates import RateSheet
from tallyspark.plans import ingest as I
from tallyspark.plans import reports as R
from tallyspark.sources import fixtures as fx
from tallyspark.sources.logs import number_lines, scan_lines

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rate_sheet_beyond_bound(spark):
    u = fx.usage_from_lineitem(spark, SF)
    small = RateSheet(fx.rate_sheet(spark), known_rows=len(fx.RATE_SHEET))
    big = RateSheet(fx.rate_sheet(spark), max_broadcast_rows=1)
    assert small.small and not big.small
    a = sorted(tuple(r) for r in R.model_ranking(u, small).collect())
    b = sorted(tuple(r) for r in R.model_ranking(u, big).collect())
    assert a == b and len(a) > 0


def test_line_numbers_by_shuffled_join(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/logs/x.jsonl"
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps({"n": i}) for i in range(1, 501)) + "\n")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = number_lines(scan_lines(spark, f"{tmp_dir}/logs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted((json.loads(r.value)["n"], r.source_line) for r in rows) == [(i, i) for i in range(1, 501)]


def test_insert_or_ignore_by_shuffled_join(spark, tmp_dir):
    store = I.UsageStore(f"{tmp_dir}/store")
    u = fx.usage_from_events(spark, SF)
    first = u.filter("event_type = 'click'")
    first.write.partitionBy("usage_date").parquet(store.usage)
    kept_small = I.drop_known(spark, store, u)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept_big = I.drop_known(spark, store, u)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    ids_small = {r.message_id for r in kept_small.select("message_id").collect()}
    ids_big = {r.message_id for r in kept_big.select("message_id").collect()}
    assert ids_small == ids_big
    assert ids_small == {r.message_id for r in u.filter("event_type <> 'click'").select("message_id").collect()}
