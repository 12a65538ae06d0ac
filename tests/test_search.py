"""Indexed search: equal to the filter's LIKE, refreshed by loads, facts pruned."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.filters import UsageFilter
from tallyspark.plans import search as S

from usage_rows import make_usage

ROWS = [
    dict(ts="2024-01-01 00:00:00", project_slug="-Home-Alice", session_id="a"),
    dict(ts="2024-01-01 00:00:00", cwd="/x/50%off", session_id="b", git_branch=""),
    dict(ts="2024-01-02 00:00:00", git_branch="feat_x", session_id="c", cwd="/srv/one"),
    dict(ts="2024-01-03 00:00:00", git_branch="featYx", session_id="d", cwd="/srv/two"),
    dict(ts="2024-01-04 00:00:00", cwd="C:\\dir", session_id="e", model="Big-Model-4"),
    dict(ts="2024-01-05 00:00:00", cwd="/ÉTÉ/😀😀😀x", session_id="f"),
    dict(ts="2024-01-06 00:00:00", cwd="", session_id="feat-x", project_slug=""),
    dict(ts="2024-01-06 00:00:00", cwd="x" * 50_000 + "end", session_id="g"),
    dict(ts="2024-01-07 00:00:00", cwd="/srv/one", session_id="c", git_branch="feat_x"),
]
NEEDLES = ["home-ALICE", "feat_x", "feat%x", "c:\\d", "ÉTÉ", "😀😀😀", "e", "%", "__________", "srv%one", "none of these",
           "x%e_d", "xxx" * 40]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("search"))
    u = make_usage(spark, ROWS * 2)
    index = S.SearchIndex(spark, f"{base}/i")
    for load in ("usage_date >= '2024-01-04'", "usage_date < '2024-01-04'", "true"):
        index.refresh(u.where(load))
    u.write.partitionBy("usage_date").parquet(f"{base}/u")
    return spark.read.parquet(f"{base}/u"), index


def ids(usage, f):
    return sorted(r.message_id for r in usage.where(f.predicate()).select("message_id").collect())


@pytest.mark.parametrize("needle", NEEDLES)
def test_equals_the_filter(indexed, needle):
    u, index = indexed
    f = UsageFilter(search=needle)
    assert ids(*index.narrowed(u, f)) == ids(u, f)


def test_other_filters_stay(indexed):
    u, index = indexed
    for f in (UsageFilter(date_from="2024-01-02", date_to="2024-01-05", search="srv"), UsageFilter(model="m-1", search="o"),
              UsageFilter(date_from="2025-01-01", search="srv"), UsageFilter(project="x"), UsageFilter(search="")):
        assert ids(*index.narrowed(u, f)) == ids(u, f)


def test_more_texts_than_a_value_set_takes(indexed, monkeypatch):
    u, index = indexed
    monkeypatch.setattr(S, "MAX_VALUES", 1)
    monkeypatch.setattr(S, "MAX_DAYS", 1)
    for needle in ("srv", "feat_x", "e", "%"):
        f = UsageFilter(search=needle)
        assert ids(*index.narrowed(u, f)) == ids(u, f)


def test_facts_are_pruned_by_day_and_value(indexed, capsys):
    u, index = indexed
    rows, rest = index.narrowed(u, UsageFilter(search="srv/T"))
    rows.where(rest.predicate()).explain("formatted")
    plan = capsys.readouterr().out
    assert "LIKE" not in plan.upper() and "translate" not in plan
    assert "PartitionFilters: [isnotnull(usage_date" in plan and "2024-01-03" in plan
    assert "PushedFilters" in plan and "EqualTo(cwd,/srv/two)" in plan


def test_a_refresh_adds_only_what_is_new(indexed):
    _, index = indexed
    values, postings = index._read("values", S.VALUES), index._read("postings", S.POSTINGS)
    assert values.count() == values.select("field", "value", "usage_date").distinct().count()
    assert postings.count() == postings.distinct().count()


def test_values_without_postings_of_a_lost_run(spark, tmp_dir):
    u = make_usage(spark, ROWS)
    index = S.SearchIndex(spark, tmp_dir)
    whole = index._write

    def lost(rows, name, key):
        if name == "values":
            raise RuntimeError("lost driver")
        whole(rows, name, key)

    index._write = lost
    with pytest.raises(RuntimeError):
        index.refresh(u)
    index._write = whole
    index.refresh(u)
    for needle in ("feat_x", "srv"):
        assert ids(*index.narrowed(u, UsageFilter(search=needle))) == ids(u, UsageFilter(search=needle))


def test_empty_tables(spark, tmp_dir):
    index = S.SearchIndex(spark, tmp_dir)
    u = make_usage(spark, ROWS)
    index.refresh(u.limit(0))
    assert index.find("srv").count() == 0
    assert index.narrowed(u, UsageFilter(search="srv"))[0].where(F.lit(True)).count() == 0
