"""Running totals: windows by differences, late rows and lost days, what is read."""

import datetime as dt

import pytest

from tallyspark.functions.filters import UsageFilter
from tallyspark.plans import reports as R
from tallyspark.plans.prefixes import PrefixTotals
from tallyspark.plans.rollups import DayRollup
from tallyspark.sources import fixtures as fx

from usage_rows import make_usage

WINDOWS = [(None, None), ("2024-01-03", "2024-01-06"), ("2024-01-10", "2024-01-13"), ("2025-01-01", None), (None, "2023-01-01"),
           ("2024-01-06", "2024-01-02")]


def rows(n, day0, models):
    return [dict(ts=f"2024-01-{day0 + i % 5:02d} 10:00:00", session_id=f"s{(i * i) % 40}", project_slug="p",
                 model="<synthetic>" if i % 11 == 0 else f"m-{models[i % len(models)]}", input_tokens=i) for i in range(n)]


def built(spark, base, u):
    rollup = DayRollup(spark, base)
    rollup.refresh(u)
    prefixes = PrefixTotals(spark, base, rollup)
    prefixes.refresh()
    return rollup, prefixes


def same(prefixes, u, rates):
    for lo, hi in WINDOWS:
        f = UsageFilter(date_from=lo, date_to=hi)
        got = prefixes.summary(rates, f)
        assert got.collect() == R.summary(u, rates, f).select(*got.columns).collect(), (lo, hi)


def test_windows_late_rows_and_lost_days(spark, tmp_dir):
    rates = fx.bounded_rate_sheet(spark)
    # Days 1-5 and 10-14, with a gap; model 1 ends early, model 3 begins late.
    u = make_usage(spark, rows(60, 1, "12") + rows(60, 10, "23"))
    late = make_usage(spark, rows(60, 1, "12") + rows(60, 10, "23") + rows(7, 4, "145"))
    rollup, prefixes = built(spark, f"{tmp_dir}/p", u)
    same(prefixes, u, rates)

    before = spark.read.parquet(f"{prefixes.path}/usage_date=2024-01-03").inputFiles()
    rollup.refresh(late, late.where("usage_date >= '2024-01-04' and usage_date < '2024-01-10'").select("usage_date").distinct())
    prefixes.refresh(dt.date(2024, 1, 4))
    same(prefixes, late, rates)
    assert spark.read.parquet(f"{prefixes.path}/usage_date=2024-01-03").inputFiles() == before

    left = late.where("usage_date not in ('2024-01-01', '2024-01-12')")
    rollup.refresh(left, late.where("usage_date in ('2024-01-01', '2024-01-12')").select("usage_date").distinct())
    prefixes.refresh(dt.date(2024, 1, 1))
    same(prefixes, left, rates)


def test_a_window_reads_two_days(spark, tmp_dir):
    _, prefixes = built(spark, f"{tmp_dir}/p", make_usage(spark, rows(60, 1, "12")))
    read = prefixes.totals(UsageFilter(date_from="2024-01-02", date_to="2024-01-04")).inputFiles()
    assert {p.split("usage_date=")[1][:10] for p in read} == {"2024-01-01", "2024-01-04"}
    with pytest.raises(ValueError):
        prefixes.totals(UsageFilter(project="p"))


def test_empty_facts(spark, tmp_dir):
    u = make_usage(spark, rows(1, 1, "1"))  # the placeholder model alone
    _, prefixes = built(spark, f"{tmp_dir}/p", u)
    assert prefixes.totals().count() == 0
