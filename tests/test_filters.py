"""Date bounds (K4-K8), page arguments (K21), search (K20), presets (F-08/F-09)."""

import datetime as dt

from tallyspark.functions.filters import (UsageFilter, from_date, page_args, preset_bounds, previous_period,
                                          to_date_exclusive)

from usage_rows import make_usage

D = dt.date


def test_from_bounds():
    assert from_date("2024-01-05") == D(2024, 1, 5)
    assert from_date("2024-01-05T23:30:00-05:00") == D(2024, 1, 5)  # date as written, not UTC
    assert from_date("2024-01-05T10:00:00.123456789Z") == D(2024, 1, 5)
    assert from_date("2024-13-05") is None and from_date("yesterday") is None and from_date("") is None
    assert from_date("2024-02-30T00:00:00Z") is None


def test_to_bounds():
    assert to_date_exclusive("2024-01-05") == D(2024, 1, 6)  # date-only: inclusive of that day
    assert to_date_exclusive("2024-01-05T15:00:00Z") == D(2024, 1, 5)  # RFC 3339: own day excluded
    assert to_date_exclusive("2024-01-05T01:00:00+09:00") == D(2024, 1, 5)
    assert to_date_exclusive("nope") is None


def test_first_and_last_years():
    assert to_date_exclusive("9999-12-31") is None and to_date_exclusive("9999-12-30") == D(9999, 12, 31)
    assert from_date("0001-01-01T00:00:00+01:00") == D(1, 1, 1)
    assert to_date_exclusive("9999-12-31T23:00:00-05:00") == D(9999, 12, 31)
    as_of = dt.datetime(2024, 1, 20)
    assert previous_period("0001-01-01T00:00:00+01:00", None, as_of) is None  # no such window lies before
    assert previous_period("2024-01-01", "9999-12-31", as_of) is None


def test_filter_rows(spark):
    u = make_usage(spark, [
        dict(ts="2024-01-04 23:59:59.999999"), dict(ts="2024-01-05 00:00:00"), dict(ts="2024-01-05 23:59:59"),
        dict(ts="2024-01-06 00:00:00"), dict(ts="0001-01-01 00:00:00"), dict(ts="2024-01-05 12:00:00", model="<synthetic>"),
    ])

    def n(f):
        return u.filter(f.predicate()).count()

    assert n(UsageFilter()) == 5  # synthetic excluded, year-1 row kept
    assert n(UsageFilter(date_from="2024-01-05", date_to="2024-01-05")) == 2
    assert n(UsageFilter(date_from="2024-01-05T00:00:00Z", date_to="2024-01-05T23:00:00Z")) == 0
    assert n(UsageFilter(date_from="garbage", date_to="garbage")) == 5


def test_page_args():
    assert page_args(None, None) == (50, 0)
    assert page_args("0", "-1") == (50, 0)
    assert page_args("1", "3") == (1, 3)
    assert page_args("500", "0") == (500, 0)
    assert page_args("501", "x") == (50, 0)
    assert page_args("abc", "10") == (50, 10)


def test_search_like_semantics(spark):
    u = make_usage(spark, [
        dict(ts="2024-01-01 00:00:00", project_slug="-Home-Alice", session_id="a"),
        dict(ts="2024-01-01 00:00:00", cwd="/x/50%off", session_id="b"),
        dict(ts="2024-01-01 00:00:00", git_branch="feat_x", session_id="c"),
        dict(ts="2024-01-01 00:00:00", git_branch="featYx", session_id="d"),
        dict(ts="2024-01-01 00:00:00", cwd="C:\\dir", session_id="e"),
        dict(ts="2024-01-01 00:00:00", cwd="/ÉTÉ", session_id="f"),
    ])

    def hits(text):
        return sorted(r.session_id for r in u.filter(UsageFilter(search=text).predicate()).collect())

    assert hits("home-ALICE") == ["a"]  # ASCII case-insensitive
    assert hits("feat_x") == ["c", "d"]  # user "_" is a wildcard
    assert hits("50%") == ["b"]
    assert hits("c:\\d") == ["e"]  # backslash is literal
    assert hits("été") == []  # non-ASCII letters are not folded
    assert hits("ÉTÉ") == ["f"]


def test_presets_and_previous_period():
    as_of = dt.datetime(2024, 1, 20, 12, 0, 0)
    f, t, b = preset_bounds("24h", as_of)
    assert (f, t, b) == ("2024-01-19T12:00:00.000Z", None, "hour")
    assert preset_bounds("7d", as_of)[0] == "2024-01-13T12:00:00.000Z"
    assert preset_bounds("month", as_of)[0] == "2024-01-01T00:00:00.000Z"
    assert preset_bounds("all", as_of) == (None, None, "day")
    c = previous_period(None, None, as_of)
    assert (c.previous_from, c.previous_to, c.current_from, c.label) == (
        "2023-12-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z", "vs last month")
    c = previous_period("2024-01-13T12:00:00.000Z", None, as_of)
    assert (c.previous_from, c.previous_to, c.label) == (
        "2024-01-06T12:00:00.000Z", "2024-01-13T12:00:00.000Z", "vs previous 7 days")
    assert previous_period("2024-01-19T12:00:00.000Z", None, as_of).label == "vs previous 24 hours"
    assert previous_period("2024-01-21", "2024-01-20", as_of) is None
