"""Report rules on small hand-made tables (K2, K3, K11-K13, K16-K18, P-13..P-19)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.filters import UsageFilter
from tallyspark.plans import reports as R

from usage_rows import make_rates, make_usage

RATES = [("m-1", 1.0, 2.0, 0.5, 0.1), ("fam-4", 10.0, 20.0, 5.0, 1.0)]


@pytest.fixture(scope="module")
def usage(spark):
    return make_usage(spark, [
        dict(ts="2024-01-01 10:00:00", session_id="s1", project_slug="-a", cwd="/a/x", model="m-1", input_tokens=100, output_tokens=10),
        dict(ts="2024-01-01 11:00:00", session_id="s1", project_slug="-b", cwd="/a/y", model="fam-4-7", input_tokens=1000, git_branch="main"),
        dict(ts="2024-01-02 09:00:00", session_id="s2", project_slug="-a", cwd="", model="m-1", output_tokens=5, git_branch="dev"),
        dict(ts="2024-01-02 09:30:00", session_id="s3", project_slug="-c", model="<synthetic>", input_tokens=7),
        dict(ts="0001-01-01 00:00:00", session_id="s4", project_slug="-a", model="nope-1", cache_read_tokens=3),
    ])


@pytest.fixture(scope="module")
def rates(spark):
    return make_rates(spark, RATES)


def test_synthetic_asymmetry(usage):
    projects = [r.project_key for r in R.filter_projects(usage).collect()]
    assert projects == ["-a", "-c", "/a/x", "/a/y"]  # synthetic-only project listed
    assert [r.model for r in R.filter_models(usage).collect()] == ["fam-4-7", "m-1", "nope-1"]


def test_summary_and_sessions(usage, rates):
    s = R.summary(usage, rates).collect()[0]
    assert (s.sessions, s.messages, s.input_tokens) == (3, 4, 1100)
    page = R.session_page(usage, rates).collect()
    keys = [(r.session_id, r.project_slug) for r in page]
    assert len(keys) == 4 and page[0].total == 4  # (session, slug) rows, not sessions
    s1 = [r for r in page if r.session_id == "s1"]
    assert len({r.cost_usd for r in s1}) == 1  # cost keyed by session only
    assert s1[0].cost_usd == pytest.approx(100 * 1 / 1e6 + 10 * 2 / 1e6 + 1000 * 10 / 1e6)
    assert page[-1].session_id == "s4"  # year-1 row sorts last by last_seen


def test_session_max_cwd(spark, rates):
    u = make_usage(spark, [dict(ts="2024-01-01 00:00:00", cwd="/z"), dict(ts="2024-01-02 00:00:00", cwd="/a")])
    row = R.session_page(u, rates).collect()[0]
    assert row.cwd == "/z" and row.models == "m-1"


def test_costs_agree(usage, rates):
    total = R.summary(usage, rates).collect()[0].cost_usd
    by_model = sum(r.cost_usd for r in R.model_ranking(usage, rates).collect())
    by_day = sum(r.cost_usd for r in R.time_series(usage, rates).collect())
    by_project = sum(r.cost_usd for r in R.project_ranking(usage, rates).collect())
    assert total == pytest.approx(by_model) == pytest.approx(by_day) == pytest.approx(by_project)


def test_unpriced_and_matches(usage, rates):
    assert [r.model for r in R.unpriced_models(usage, rates).collect()] == ["nope-1"]
    m = {r.model: r.matched_model for r in R.model_rate_matches(usage, rates).collect()}
    assert m == {"m-1": "m-1", "fam-4-7": "fam-4", "nope-1": None}


def test_time_series_no_gaps(usage, rates):
    keys = [r.bucket for r in R.time_series(usage, rates).collect()]
    assert keys == ["0001-01-01", "2024-01-01", "2024-01-02"]
    hours = [r.bucket for r in R.time_series(usage, rates, bucket="hour").collect()]
    assert "2024-01-01 10:00:00" in hours and len(hours) == 4


def test_period_comparison_zero_previous(usage, rates):
    f = UsageFilter(date_from="2024-01-01T00:00:00Z")
    out = {r.metric: r for r in R.period_comparison(usage, rates, f, dt.datetime(2024, 1, 3)).collect()}
    assert out["messages"].direction == "new" and out["messages"].pct_change == float("inf")
    assert out["cache_read_tokens"].pct_change == 0.0 and out["cache_read_tokens"].direction == "flat"
    assert out["messages"].label == "vs previous 2 days"
    f2 = UsageFilter(date_from="2024-01-02T00:00:00Z")
    out2 = {r.metric: r for r in R.period_comparison(usage, rates, f2, dt.datetime(2024, 1, 3)).collect()}
    assert out2["messages"].direction == "down" and out2["messages"].pct_change == -50.0


def test_scalars(spark):
    df = spark.createDataFrame([("-home-u-x", "HEAD", 79.9), ("/abs", "", 80.0), ("plain", "main", 100.0), (None, None, 0.0)],
                               "s string, b string, p double")
    rows = df.select(S.slug_to_path(F.col("s")).alias("path"), S.has_branch(F.col("b")).alias("hb"),
                     S.budget_status(F.col("p")).alias("st"), S.budget_bar_pct(F.col("p") * 2).alias("bar")).collect()
    assert [r.path for r in rows] == ["/home/u/x", "/abs", "plain", ""]
    assert [r.hb for r in rows] == [False, False, True, False]
    assert [r.st for r in rows] == ["ok", "warn", "over", "ok"]
    assert [r.bar for r in rows] == [100.0, 100.0, 100.0, 0.0]


def test_pct_change_guard(spark):
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (6.0, 4.0), (2.0, 4.0)], "a double, b double")
    rows = df.select(S.pct_change(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == [float("inf"), 0.0, 50.0, -50.0]


def test_metric_breakdown_share(usage, rates):
    rows = R.metric_breakdown(usage, rates, "input_tokens").collect()
    assert [r.label for r in rows] == ["fam-4-7", "m-1"]
    assert rows[0].share_pct == pytest.approx(1000 / 1100 * 100)
    assert [r.rank for r in rows] == [1, 2]


def test_session_drilldown(usage, rates):
    rows = R.session_records(usage, rates, session_id="s1").collect()
    assert [r.model for r in rows] == ["m-1", "fam-4-7"]  # oldest first, one session only
    assert rows[0].cost_usd == pytest.approx(100 * 1 / 1e6 + 10 * 2 / 1e6)
    assert rows[1].cost_usd == pytest.approx(1000 * 10 / 1e6) and rows[1].git_branch == "main"
    assert R.session_records(usage, rates, session_id="s3").count() == 0  # synthetic only


def test_single_bucket_drilldown(usage, rates):
    rows = R.bucket_breakdown(usage, rates, bucket="day", bucket_value="2024-01-01").collect()
    assert {r.bucket for r in rows} == {"2024-01-01"}
    assert [r.model for r in rows] == ["fam-4-7", "m-1"]  # cost descending
    assert sum(r.share_pct for r in rows) == pytest.approx(100.0)
    assert rows[0].sessions == 1 and rows[0].messages == 2
