"""Change sets: several edits of one key leave one row, the last (M-05, M-08..M-10, M-13); display orders (O-02..O-09)."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyspark import oracle as O
from tallyspark.functions.scalars import stored_time
from tallyspark.operators.keyed import last_per_key, numbered
from tallyspark.plans import budgets as B
from tallyspark.plans import pricing_sync as PS
from tallyspark.plans import reports as R
from tallyspark.schemas import BUDGETS, PRICING, RATE_COLUMNS
from tallyspark.session import scratch_dir
from tallyspark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 1)


def rate(model, value, pos):
    return (pos, model, value, value, value, value, "", None)


def edits(spark, *rows):
    cols = ", ".join(f"{c} double" for c in RATE_COLUMNS)
    return spark.createDataFrame(list(rows), f"pos long, model string, {cols}, source string, fetched_at timestamp_ntz")


def test_the_last_edit_of_a_rate_stays(spark):
    sheet = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, "seed", None, None)], PRICING)
    out = PS.upsert_rates(sheet, edits(spark, rate("a", 3.0, 2), rate("a", 2.0, 1), rate("b", 9.0, 1)), NOW)
    assert sorted((r.model, r.input_per_mtok_usd, r.source) for r in out.collect()) == [("a", 3.0, "manual"), ("b", 9.0, "manual")]
    out, status = PS.update_rates(sheet, edits(spark, rate("a", 3.0, 2), rate("a", 2.0, 1), rate("x", 1.0, 1)), NOW)
    assert [(r.model, r.input_per_mtok_usd, r.source) for r in out.collect()] == [("a", 3.0, "seed")]
    assert sorted(r.status for r in status.collect()) == ["not_found", "updated", "updated"]


def test_the_last_edit_of_a_budget_stays(spark):
    b = spark.createDataFrame([(1, "x", 5.0, False, NOW, NOW)], BUDGETS)
    ch = spark.createDataFrame([(1, 1, "y", 6.0, True), (2, 1, "z", 7.0, False)], "pos long, id long, name string, amount_usd double, show_in_dashboard boolean")
    out, _ = B.update_budgets(b, ch, NOW)
    assert [(r.name, r.amount_usd) for r in out.collect()] == [("z", 7.0)]


def test_last_per_key_without_pos_takes_input_order(spark):
    df = spark.createDataFrame([("k", i) for i in range(9)], "k string, v int").coalesce(1)
    assert [tuple(r) for r in last_per_key(df, "k").collect()] == [("k", 8)]


def test_numbered_is_gapless_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x")).repartition(7)
    assert sorted(tuple(r) for r in numbered(df, ["x"], "n").collect()) == [(i, i + 1) for i in range(500)]


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-20T12:00:00.123456789Z", "2024-01-20 12:00:00.123456"),
    ("2024-01-20T12:00:00.1234567+02:00", "2024-01-20 10:00:00.123456"),
    ("2024-01-20 12:00:00.123456789", "2024-01-20 12:00:00.123456"),
    ("2024-01-20 12:00:00.5", "2024-01-20 12:00:00.500000"),
    ("2024-01-20", None),
])
def test_stored_times_keep_microseconds(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(stored_time(F.col("t")).alias("t")).first().t
    assert (got and got.strftime("%Y-%m-%d %H:%M:%S.%f")) == want


ORDERS = {  # report -> the order its rows come in
    "model_ranking": "cost_usd DESC, model",
    "project_ranking": "cost_usd DESC, project_key",
    "session_records": "ts, message_id",
    "time_series_by_model": "bucket, model",
    "bucket_breakdown": "bucket, cost_usd DESC, model",
    "price_sync_sheet": "output_per_mtok_usd DESC, input_per_mtok_usd DESC, model",
    "metric_breakdown_output": "value DESC, label",
}


@pytest.mark.parametrize("name", ORDERS)
def test_rows_come_in_display_order(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = df.columns
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]}) ORDER BY {ORDERS[name]}").fetchall()
    keys = [cols.index(k.split()[0]) for k in ORDERS[name].split(", ") if not k.endswith("DESC")]
    assert [[r[k] for k in keys] for r in df.collect()] == [[r[k] for k in keys] for r in want]


def test_keyset_paging_equals_offsets(spark):
    u, rates = fx.usage_from_events(spark, SF), fx.bounded_rate_sheet(spark)
    first = R.session_page(u, rates, limit=7).collect()
    last = first[-1]
    after = (last.last_seen, last.session_id, last.project_slug)
    page = [r.session_id for r in R.session_page(u, rates, limit=7, after=after).collect()]
    assert page == [r.session_id for r in R.session_page(u, rates, limit=7, offset=7).collect()] and len(page) == 7


@pytest.mark.parametrize("name", ["project_ranking_events", "period_comparison_7d", "metric_breakdown_messages", "metric_breakdown_output", "session_page_offset"])
def test_reports_do_not_scan_the_facts_again(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan  # the fine aggregate was staged by one scan


def test_a_bucket_drill_prunes_days(spark, tmp_dir):
    fx.usage_from_events(spark, SF).write.partitionBy("usage_date").parquet(f"{tmp_dir}/u")
    stored = spark.read.parquet(f"{tmp_dir}/u")
    df = R.bucket_breakdown(stored, fx.bounded_rate_sheet(spark), bucket="hour", bucket_value="2024-01-10 05:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in plan and O.TOK


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session())
