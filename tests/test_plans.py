"""Plan shape of the registered reports (planning only, nothing executed):
no Python UDFs, no cartesian / nested-loop joins, one-row results as
subqueries, date filters pruning partitions of a stored fact table."""

import pytest

import __spark_entry__ as E
from tallyspark.functions.filters import UsageFilter
from tallyspark.plans import reports as R
from tallyspark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
# Queries whose callables write files (ingest, streaming) are planned elsewhere.
SIDE_EFFECTS = {
    "ingest_event_logs", "stream_ingest_event_logs", "deleted_records_ranking", "stored_sheet_older_layout",
    "live_bucket_totals", "ingest_late_batch", "ingest_odd_names", "ingest_lines", "ingest_quarantine", "ingest_manifest",
}
NAMES = sorted(n for n in E._report_queries() if n not in SIDE_EFFECTS)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_udf_no_cross_join(spark, name):
    plan = physical(E._report_queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_one_row_results_are_subqueries(spark):
    u, rates = fx.usage_from_events(spark, SF), fx.bounded_rate_sheet(spark)
    assert "Subquery" in physical(R.summary(u, rates))
    assert "Subquery" in physical(R.session_page(u, rates))


def test_date_filter_prunes_stored_partitions(spark, tmp_dir):
    path = f"{tmp_dir}/usage"
    fx.usage_from_events(spark, SF).write.partitionBy("usage_date").parquet(path)
    stored = spark.read.parquet(path)
    f = UsageFilter(date_from="2024-01-05", date_to="2024-01-09", project="/u/1/1")
    plan = physical(R.model_ranking(stored, fx.bounded_rate_sheet(spark), f))
    assert "PartitionFilters: [isnotnull(usage_date" in plan and "usage_date#" in plan
    assert "PushedFilters: [" in plan and "EqualTo(project_key," in plan  # Spark truncates the literal
    # Only the columns the report needs are read.
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "cwd" not in read_schema and "request_id" not in read_schema
    # The date bounds select 4 days of partitions.
    df = R.model_ranking(stored, fx.bounded_rate_sheet(spark), f)
    assert df.count() > 0
