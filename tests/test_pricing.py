"""Feed normalisation (P-09..P-12), sync merge and counters (M-06/M-07), seeds,
strict create / update / delete (M-08..M-10), budgets (M-13)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import budgets as B
from tallyspark.plans import pricing_sync as PS
from tallyspark.schemas import BUDGETS, PRICING
from tallyspark.sources.feed import read_feed_snapshot
from tallyspark.sources.tables import read_latest, write_version

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)


def feed_doc():
    def m(i, p, c, r="", w=""):
        return {"id": i, "pricing": {"prompt": p, "completion": c, "input_cache_read": r, "input_cache_write": w}}

    return {"data": [
        m("anthropic/claude-opus-4.7", "0.000015", "0.000075", "0.0000015", "0.00001875"),
        m("other/claude-opus-4.7", "1", "1"),
        m("anthropic/claude-x:thinking", "0.000001", "0.000001"),
        m("anthropic/free-1", "0", "0"),
        m("anthropic/nocache-1", "0.000004", "0.00002"),
        m("anthropic/bad-1", "abc", "0.000002"),
        m("anthropic/huge-1", "1e999", "0.000002"),
        m("anthropic/dup.1", "0.000001", "0.000001"),
        m("anthropic/dup-1", "0.000002", "0.000002"),
    ]}


@pytest.fixture()
def feed_rows(spark, tmp_dir):
    path = f"{tmp_dir}/feed.json"
    with open(path, "w") as fh:
        json.dump(feed_doc(), fh, indent=2)
    return PS.normalise_feed(read_feed_snapshot(spark, path), NOW)


def test_normalise_feed(feed_rows):
    got = {r.model: r for r in feed_rows.collect()}
    assert set(got) == {"claude-opus-4-7", "nocache-1", "bad-1", "huge-1", "dup-1"}
    assert got["claude-opus-4-7"].input_per_mtok_usd == pytest.approx(15.0)
    assert got["claude-opus-4-7"].cache_write_per_mtok_usd == pytest.approx(18.75)
    assert got["nocache-1"].cache_write_per_mtok_usd == pytest.approx(5.0)  # 1.25 x input
    assert got["nocache-1"].cache_read_per_mtok_usd == pytest.approx(0.4)  # 0.10 x input
    assert got["bad-1"].input_per_mtok_usd == 0.0 and got["huge-1"].input_per_mtok_usd == 0.0
    assert got["dup-1"].input_per_mtok_usd == pytest.approx(2.0)  # later entry wins
    assert got["dup-1"].source == "openrouter" and str(got["dup-1"].fetched_at) == str(NOW)


def sheet(spark, rows):
    return spark.createDataFrame([(m, i, o, w, r, s, None, None) for (m, i, o, w, r, s) in rows], PRICING)


def test_sync_merge(spark, feed_rows):
    old = sheet(spark, [
        ("claude-opus-4-7", 1.0, 1.0, 1.0, 1.0, "manual"),
        ("nocache-1", 1.0, 1.0, 1.0, 1.0, "seed"),
        ("dup-1", 1.0, 1.0, 1.0, 1.0, "openrouter"),
        ("local-only", 2.0, 2.0, 2.0, 2.0, "manual"),
    ])
    new, counters = PS.sync(old, feed_rows)
    c = counters.collect()[0]
    assert (c.inserted, c.updated, c.skipped_manual) == (2, 2, 1)
    got = {r.model: r for r in new.collect()}
    assert got["claude-opus-4-7"].input_per_mtok_usd == 1.0 and got["claude-opus-4-7"].source == "manual"
    assert got["nocache-1"].source == "openrouter" and got["nocache-1"].input_per_mtok_usd == pytest.approx(4.0)
    assert "local-only" in got and "huge-1" in got and len(got) == 6


def test_seed_and_edits(spark):
    base = sheet(spark, [("claude-opus-4-7", 1.0, 1.0, 1.0, 1.0, "manual")])
    seeded = PS.seed_missing(spark, base, NOW)
    got = {r.model: r for r in seeded.collect()}
    assert len(got) == 8 and got["claude-opus-4-7"].input_per_mtok_usd == 1.0
    assert got["claude-haiku-4-5"].source == "seed" and got["claude-haiku-4-5"].output_per_mtok_usd == 5.0

    changes = spark.createDataFrame(
        [(0, " new-1 ", 1.0, 2.0, 0.0, 0.0, "openrouter", None, None), (1, "claude-opus-4-7", 9.0, 9.0, 9.0, 9.0, None, None, None),
         (2, "new-1", 5.0, 5.0, 5.0, 5.0, None, None, None)],
        "pos long, model string, input_per_mtok_usd double, output_per_mtok_usd double, cache_write_per_mtok_usd double, "
        "cache_read_per_mtok_usd double, source string, fetched_at timestamp_ntz, updated_at timestamp_ntz")
    created, status = PS.create_rates(seeded, changes, NOW)
    st = sorted((r.pos, r.status) for r in status.collect())
    assert st == [(0, "created"), (1, "conflict"), (2, "conflict")]
    row = {r.model: r for r in created.collect()}["new-1"]
    assert row.source == "manual" and row.input_per_mtok_usd == 1.0

    upd = spark.createDataFrame([("claude-haiku-4-5", 2.0, 10.0, 2.5, 0.2, None, NOW, None), ("ghost", 1.0, 1.0, 1.0, 1.0, None, None, None)], PRICING)
    updated, status = PS.update_rates(created, upd, NOW)
    assert {r.model: r.status for r in status.collect()} == {"claude-haiku-4-5": "updated", "ghost": "not_found"}
    h = {r.model: r for r in updated.collect()}["claude-haiku-4-5"]
    assert h.source == "seed" and h.fetched_at is None and h.input_per_mtok_usd == 2.0

    gone = PS.delete_rates(updated, spark.createDataFrame([("new-1",), ("absent",)], "model string"))
    assert "new-1" not in {r.model for r in gone.collect()}


def test_versioned_sheet(spark, tmp_dir):
    base = f"{tmp_dir}/pricing"
    assert read_latest(spark, base) is None
    s1 = sheet(spark, [("a", 1.0, 1.0, 1.0, 1.0, "manual")])
    assert write_version(spark, s1, base) == 1
    s2 = PS.seed_missing(spark, read_latest(spark, base), NOW)
    assert write_version(spark, s2, base) == 2  # never overwrites the version being read
    assert read_latest(spark, base).count() == 9


def test_budget_change_sets(spark):
    empty = spark.createDataFrame([], BUDGETS)
    req = spark.createDataFrame([(0, "a", 10.0), (1, "", 5.0), (2, "b", 0.0), (3, "c", 20.0)],
                                "pos long, name string, amount_usd double")
    b1, st = B.create_budgets(empty, req, NOW)
    assert [r.status for r in st.orderBy("pos").collect()] == ["created", "invalid", "invalid", "created"]
    assert [(r.id, r.name, r.show_in_dashboard) for r in b1.orderBy("id").collect()] == [(1, "a", False), (2, "c", False)]
    upd = spark.createDataFrame([(2, "c2", 30.0, True), (9, "z", 1.0, False), (1, "a", -1.0, True)],
                                "id long, name string, amount_usd double, show_in_dashboard boolean")
    b2, st = B.update_budgets(b1, upd, NOW)
    assert {r.id: r.status for r in st.collect()} == {2: "updated", 9: "not_found", 1: "invalid"}
    got = {r.id: r for r in b2.collect()}
    assert got[2].name == "c2" and got[2].show_in_dashboard and got[1].amount_usd == 10.0
    b3 = B.delete_budgets(b2, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in b3.collect()] == [2]
