"""Stored table readers: late-added columns get defaults (S-12..S-14), stored
time text is parsed from the accepted layouts (P-02)."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions.scalars import stored_time
from tallyspark.sources.tables import read_budgets, read_pricing


def test_read_pricing_defaults(spark, tmp_dir):
    path = f"{tmp_dir}/pricing"
    spark.createDataFrame(
        [("b", 1.0, 2.0, 0.5, 0.1, "2024-01-02T03:04:05Z", ""), ("a", 1.0, 2.0, 0.5, 0.1, None, "garbage")],
        "model string, input_per_mtok_usd double, output_per_mtok_usd double, cache_write_per_mtok_usd double, "
        "cache_read_per_mtok_usd double, fetched_at string, updated_at string",
    ).write.parquet(path)
    rows = read_pricing(spark, path).collect()
    assert [r.model for r in rows] == ["a", "b"]
    assert {r.source for r in rows} == {"manual"}
    b = rows[1]
    assert b.fetched_at == dt.datetime(2024, 1, 2, 3, 4, 5) and b.updated_at is None
    assert rows[0].updated_at is None


def test_read_budgets_defaults(spark, tmp_dir):
    path = f"{tmp_dir}/budgets"
    spark.createDataFrame([(2, "b", 5.0), (1, "a", 3.0)], "id long, name string, amount_usd double").write.parquet(path)
    rows = read_budgets(spark, path).collect()
    assert [(r.id, r.show_in_dashboard) for r in rows] == [(1, False), (2, False)]


def test_stored_time_layouts(spark):
    texts = ["2024-01-02T03:04:05.123456+02:00", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.5",
             "2024-01-02 03:04:05", "nope"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(stored_time(F.col("t")).alias("v")).collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 1, 4, 5, 123456)
    assert got[1] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got[3] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got[4] is None
