"""Day rollups: distinct sessions of any window from bitmaps, refreshed days."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.filters import UsageFilter
from tallyspark.plans import reports as R
from tallyspark.plans.rollups import DayRollup
from tallyspark.sources import fixtures as fx

from usage_rows import make_usage


def rows(n, day0=1, sessions=50):
    return [dict(ts=f"2024-01-{day0 + i % 9:02d} 10:00:00", session_id=f"s{(i * i) % sessions}",
                 project_slug=f"p{i % 4}", model="m-1" if i % 11 else "<synthetic>", input_tokens=i) for i in range(n)]


@pytest.mark.parametrize("f", [UsageFilter(), UsageFilter(date_from="2024-01-03", date_to="2024-01-06"),
                               UsageFilter(date_from="2024-01-02", project="p1"), UsageFilter(date_from="2025-01-01")])
def test_windows_equal_the_reports(spark, tmp_dir, f):
    u = make_usage(spark, rows(300) + rows(200, 12, 90))
    rates = fx.bounded_rate_sheet(spark)
    rollup = DayRollup(spark, f"{tmp_dir}/r")
    rollup.refresh(u.where("usage_date < '2024-01-12'"))
    rollup.refresh(u, u.where("usage_date >= '2024-01-12'").select("usage_date").distinct())
    assert rollup.summary(rates, f).collect() == R.summary(u, rates, f).select(*rollup.summary(rates, f).columns).collect()
    assert rollup.project_ranking(rates, f).collect() == R.project_ranking(u, rates, f).collect()


def test_numbers_are_dense_and_kept(spark, tmp_dir):
    rollup = DayRollup(spark, f"{tmp_dir}/r")
    rollup.refresh(make_usage(spark, rows(300)))
    first = {r.session_id: r.number for r in rollup._sessions().collect()}
    assert sorted(first.values()) == list(range(len(first)))
    rollup.refresh(make_usage(spark, rows(300, 12, 400)), make_usage(spark, rows(9, 12)).select("usage_date"))
    both = {r.session_id: r.number for r in rollup._sessions().collect()}
    assert sorted(both.values()) == list(range(len(both))) and first.items() <= both.items()


def test_a_day_that_lost_its_rows_counts_nothing(spark, tmp_dir):
    u = make_usage(spark, rows(90))
    rollup = DayRollup(spark, f"{tmp_dir}/r")
    rollup.refresh(u)
    gone = u.where("usage_date = '2024-01-05'").select("usage_date").distinct()
    rollup.refresh(u.where("usage_date <> '2024-01-05'"), gone)
    left = u.where("usage_date <> '2024-01-05' and model <> '<synthetic>'")
    assert rollup.sessions().first().sessions == left.agg(F.countDistinct("session_id")).first()[0]
    with pytest.raises(ValueError):
        rollup.sessions(UsageFilter(model="m-1"))
