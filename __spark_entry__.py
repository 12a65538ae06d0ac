"""

Every query reads the driver's tables through the usage views of
``tallyspark.sources.fixtures`` (work grows with the tables) and runs a
report of ``tallyspark.plans``.  ``present`` only normalises output types for
the comparison (integers as BIGINT, doubles rounded to 6 places, times and
lists as text); the DuckDB side in ``tallyspark.oracle`` produces the same
shapes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import oracle as O
from tallyspark.functions.filters import UsageFilter, preset_bounds
from tallyspark.plans import budgets as B
from tallyspark.plans import ingest as I
from tallyspark.plans import pricing_sync as PS
from tallyspark.plans import reports as R
from tallyspark.session import apply_required_conf, fresh_path
from tallyspark.sources import fixtures as fx

try:  # corpus operators: a separable subpackage
    import corpus_pipeline
    from tallyspark.llm import queries as corpus
except ImportError:  # not there, or something it needs is not: the other queries do without
    corpus = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = c.cast("double")
            special = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
            c = F.when(special, d).otherwise(F.round(d.cast("decimal(38,9)"), 6).cast("double"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _as_of(view: str) -> dt.datetime:
    return dt.datetime.fromisoformat(fx.AS_OF[view])


def _ctx(spark: SparkSession, sf_dir: str, view: str):
    apply_required_conf(spark)
    return fx.USAGE_VIEWS[view](spark, sf_dir), fx.bounded_rate_sheet(spark)


def _report(view: str, fn: Callable, **kw) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u, rates = _ctx(spark, sf_dir, view)
        return present(fn(u, rates, **kw))

    return run


def _usage_only(view: str, fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u, _ = _ctx(spark, sf_dir, view)
        return present(fn(u))

    return run


# Filters used by the filtered variants (dates are the feature of the operator).
LI_RANGE = UsageFilter(date_from="1996-01-01", date_to="1997-12-31")
LI_RANGE_SQL = O.where("1996-01-01", "1998-01-01")
LI_RFC = UsageFilter(date_from="1996-03-01T23:30:00-05:00", date_to="1996-09-15T00:00:00Z")
LI_RFC_SQL = O.where("1996-03-01", "1996-09-15")
LI_PROJECT = UsageFilter(project="-seg-building")
LI_PROJECT_SQL = O.where(extra="project_key = '-seg-building'")
EV_SEARCH = UsageFilter(search="CLI_K")
EV_SEARCH_SQL = O.where(extra=O.search_filter_sql("CLI_K"))
EV_MODEL = UsageFilter(model="m-view-4-7")
EV_MODEL_SQL = O.where(extra="model = 'm-view-4-7'")
EV_7D = UsageFilter(date_from=preset_bounds("7d", _as_of("events"))[0])
EV_24H = UsageFilter(date_from=preset_bounds("24h", _as_of("events"))[0])
# What the presets and the windows before them must resolve to, as of fx.AS_OF, written out for DuckDB.
EV_7D_SQL = O.where("2024-01-13")
EV_24H_SQL = O.where("2024-01-19")


def _budget(view: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u, rates = _ctx(spark, sf_dir, view)
        return present(R.budget_report(u, rates, fx.budgets(spark), _as_of(view)))

    return run


def _comparison(view: str, f: UsageFilter) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u, rates = _ctx(spark, sf_dir, view)
        return present(R.period_comparison(u, rates, f, _as_of(view)))

    return run


def _month_start_text(view: str) -> str:
    a = _as_of(view)
    return dt.date(a.year, a.month, 1).isoformat()


def _ingest_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events -> JSONL files (one folder per slug, replays, junk) -> incremental
    ingest into a fresh store -> the stored fact rows (layout-dependent
    source_file / source_line left out)."""
    apply_required_conf(spark)
    root = fresh_path(spark, "event-logs")
    fx.write_event_logs(spark, sf_dir, root)
    store = I.UsageStore(fresh_path(spark, "usage-store"))
    I.ingest(spark, root, store, glob="*.txt")
    I.ingest(spark, root, store, glob="*.txt")  # a second run changes nothing
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


def _sync_at() -> dt.datetime:
    return dt.datetime.fromisoformat(fx.SYNC_AT)


def _synced(spark: SparkSession, sf_dir: str):
    """Feed derived from part -> normalised rows; fixture sheet + seeds -> synced sheet."""
    apply_required_conf(spark)
    now = _sync_at()
    rows = PS.normalise_feed(fx.feed_from_part(spark, sf_dir), now)
    sheet = PS.seed_missing(spark, fx.rate_sheet(spark), now)
    new_sheet, counters = PS.sync(sheet, rows)
    return rows, new_sheet, counters


def _feed_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_synced(spark, sf_dir)[0])


def _sync_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(R.price_sheet(_synced(spark, sf_dir)[1]))


def _sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_synced(spark, sf_dir)[2])


def _ranking_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    new_sheet = _synced(spark, sf_dir)[1]
    return present(R.model_ranking(fx.usage_from_lineitem(spark, sf_dir), new_sheet))


def _stream_ingest_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same landing files through the Structured Streaming path
    (AvailableNow, insert-or-ignore in foreachBatch), run twice."""
    from tallyspark.streaming import live as L

    apply_required_conf(spark)
    landing = fresh_path(spark, "landing")
    fx.write_event_logs(spark, sf_dir, landing)
    store = I.UsageStore(fresh_path(spark, "stream-store"))
    ckpt = L.checkpoint_path(store, "ingest")
    for _ in range(2):
        L.stream_ingest(spark, landing, store, ckpt, glob="*.txt").awaitTermination()
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


def _budget_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets created from nation rows (nation 0 has amount 0: rejected),
    region-1 nations updated and pinned, every fifth deleted; pinned report."""
    from tallyspark.schemas import BUDGETS

    u, rates = _ctx(spark, sf_dir, "events")
    now = _as_of("events")
    nation = fx.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    creates = nation.select(key.cast("bigint").alias("pos"), F.lower("n_name").alias("name"), (key * 25.0).alias("amount_usd"))
    b1, _ = B.create_budgets(spark.createDataFrame([], BUDGETS), creates, now)
    edit = F.explode(F.array(F.lit(40.0), F.lit(50.0))).alias("factor")  # each is edited twice, the last stays
    updates = nation.filter(F.col("n_regionkey") == 1).select("n_name", key, edit).select(
        F.col("factor").alias("pos"), key.cast("bigint").alias("id"), F.lower("n_name").alias("name"),
        (key * F.col("factor")).alias("amount_usd"), F.lit(True).alias("show_in_dashboard"),
    )
    b2, _ = B.update_budgets(b1, updates, now)
    b3 = B.delete_budgets(b2, nation.filter(key % 5 == 0).select(key.cast("bigint").alias("id")))
    return present(R.budget_report(u, rates, b3, now, pinned_only=True))


def _deleted_records_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table loaded from the events view, every record of the 'click'
    branch deleted (tombstones), the touched days compacted, then the model
    ranking of the live table."""
    apply_required_conf(spark)
    store = I.UsageStore(fresh_path(spark, "usage-store"))
    fx.usage_from_events(spark, sf_dir).write.partitionBy("usage_date").parquet(store.usage)
    stored = spark.read.parquet(store.usage)
    I.delete_records(spark, store, stored.filter(F.col("git_branch") == "click"))
    I.compact(spark, store)
    return present(R.model_ranking(I.read_usage(spark, store), fx.bounded_rate_sheet(spark)))


def _stored_sheet_older_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synced sheet stored as a table version in an older layout (no
    source column), read back with the late-column default, in display order."""
    from tallyspark.sources.tables import read_latest_path, read_pricing, write_version

    base = fresh_path(spark, "pricing")
    write_version(spark, _synced(spark, sf_dir)[1].drop("source"), base)
    return present(R.price_sheet(read_pricing(spark, read_latest_path(spark, base))))


def _loaded_logs(spark: SparkSession, sf_dir: str, write: Callable) -> I.UsageStore:
    """Logs written by ``write`` and ingested twice into a fresh store; the second run changes nothing."""
    apply_required_conf(spark)
    root = fresh_path(spark, "logs")
    write(spark, sf_dir, root)
    store = I.UsageStore(fresh_path(spark, "usage-store"))
    for _ in range(2):
        I.ingest(spark, root, store, glob="*.txt")
    return store


def _ingest_late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events arrive first, earlier ones by a second run over the same folders."""
    apply_required_conf(spark)
    root, store = fresh_path(spark, "late-logs"), I.UsageStore(fresh_path(spark, "usage-store"))
    for where in LATE_FIRST:
        fx.write_event_logs(spark, sf_dir, root, where)
        I.ingest(spark, root, store, glob="*.txt")
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


# Both halves of the events, the later half first.
LATE_FIRST = ("ts >= '2024-01-15'", "ts < '2024-01-15'")


def _streamed_late_first(spark: SparkSession, sf_dir: str) -> I.UsageStore:
    """Events streamed into a fresh store; the second micro-batch brings rows that are days late."""
    from tallyspark.streaming import live as L

    apply_required_conf(spark)
    landing, store = fresh_path(spark, "landing"), I.UsageStore(fresh_path(spark, "stream-store"))
    for where in LATE_FIRST:
        fx.write_event_logs(spark, sf_dir, landing, where)
        L.stream_ingest(spark, landing, store, L.checkpoint_path(store, "live"), glob="*.txt").awaitTermination()
    return store


def _live_bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals kept by the stream."""
    return present(I.live_totals(spark, _streamed_late_first(spark, sf_dir)).drop("usage_date"))


def _live_totals_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals after every record of the 'click' branch is deleted and storage and totals are compacted."""
    store = _streamed_late_first(spark, sf_dir)
    I.delete_records(spark, store, I.read_usage(spark, store).where("git_branch = 'click'"))
    I.compact(spark, store)
    return present(I.live_totals(spark, store).drop("usage_date"))


def _grown_logs(spark: SparkSession, sf_dir: str, write: Callable, shares: tuple[float, ...]) -> I.UsageStore:
    """Log files at several lengths of theirs, an ingest after each."""
    apply_required_conf(spark)
    whole, root = fresh_path(spark, "whole-logs"), fresh_path(spark, "growing-logs")
    write(spark, sf_dir, whole)
    store = I.UsageStore(fresh_path(spark, "usage-store"))
    for share in shares:
        fx.copy_logs(spark, whole, root, share)
        I.ingest(spark, root, store, glob="*.txt")
    return store


def _ingest_grown_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut within a line, then whole: the second run reads from the offsets of the first."""
    store = _grown_logs(spark, sf_dir, fx.write_event_logs, (0.6, 1.0))
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


def _ingest_grown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of files read in three ranges."""
    store = _grown_logs(spark, sf_dir, fx.write_numbered_logs, (0.31, 0.77, 1.0))
    return present(I.read_usage(spark, store).select("message_id", "source_line"))


def _ingest_truncated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that shrink are read from their start; what was stored stays, and nothing counts twice."""
    store = _grown_logs(spark, sf_dir, fx.write_event_logs, (0.8, 0.3, 1.0))
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


def _tail_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended lines through the tail stream: three AvailableNow runs from one checkpoint, an append before two of them."""
    from tallyspark.streaming import live as L

    apply_required_conf(spark)
    whole, root = fresh_path(spark, "whole-logs"), fresh_path(spark, "growing-logs")
    fx.write_event_logs(spark, sf_dir, whole)
    store = I.UsageStore(fresh_path(spark, "tail-store"))
    for share in (0.5, 1.0, 1.0):
        fx.copy_logs(spark, whole, root, share)
        L.tail_ingest(spark, root, store, L.checkpoint_path(store, "tail"), glob="*.txt").awaitTermination()
    return present(I.read_usage(spark, store).drop("source_file", "source_line"))


def _ingest_odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded_logs(spark, sf_dir, fx.write_odd_names)
    return present(I.read_usage(spark, store).select("message_id", "project_slug"))


def _ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded_logs(spark, sf_dir, fx.write_numbered_logs)
    return present(I.read_usage(spark, store).select("message_id", "source_line"))


def _ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded_logs(spark, sf_dir, fx.write_event_logs)
    return present(I.read_quarantine(spark, store).select("reason", "line"))


def _ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines recorded for each log folder."""
    store = _loaded_logs(spark, sf_dir, fx.write_event_logs)
    folder = F.element_at(F.split("source_file", "/"), -2).alias("slug")
    files = I.current_manifest(spark, store)
    return present(files.select(folder, "last_line").groupBy("slug").agg(F.sum("last_line").alias("lines")))


def _rate_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates created, edited twice, upserted and deleted, with the status of every edit."""
    from tallyspark.schemas import PRICING, RATE_COLUMNS

    now = _sync_at()
    part = fx.table(spark, sf_dir, "part")
    number = F.col("p_partkey").cast("bigint")
    model, key, region = F.concat(F.lit("n-"), number.cast("string")), number.cast("double"), number % 5
    later = 1 << 40  # position of the second edits

    def edits(where, factor, pos, prefix=""):
        rates = [(key * factor).alias(c) for c in RATE_COLUMNS]
        return part.where(where).select((number + pos).alias("pos"), F.concat(F.lit(prefix), model).alias("model"), *rates)

    sheet = spark.createDataFrame([], PRICING)
    sheet, created = PS.create_rates(sheet, edits(F.lit(True), 1, 0).union(edits(region == 1, 9, later)), now)
    changes = edits(region == 2, 2, 0).union(edits(region == 2, 3, later)).union(edits(region == 3, 7, 0, "no-"))
    sheet, updated = PS.update_rates(sheet, changes, now)
    sheet = PS.delete_rates(sheet, part.where(region == 4).select(model.alias("model")))
    twice = edits(region == 0, 4, 0).union(edits(region == 0, 5, later))
    upserted = PS.upsert_rates(sheet, twice.withColumns({"source": F.lit(""), "fetched_at": F.lit(None).cast("timestamp_ntz")}), now)

    def rows(kind, df, rate, state):
        return df.select(F.lit(kind).alias("kind"), "model", rate.alias("input_per_mtok_usd"), F.col(state).alias("state"))

    rate, none = F.col("input_per_mtok_usd"), F.lit(None).cast("double")
    zero = part.where(region == 0).select(model.alias("model"))
    out = rows("sheet", sheet, rate, "source").union(rows("create", created, none, "status")).union(rows("update", updated, none, "status"))
    return present(out.union(rows("upsert", upserted.join(zero, "model", "left_semi"), rate, "source")))


def _stored_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets stored without the pin flag, times as text: the flag defaults, the times are parsed."""
    from tallyspark.sources.tables import read_budgets

    path = fresh_path(spark, "budgets")
    fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") * 2.5).cast("double").alias("amount_usd"),
        F.lit("2024-01-02T03:04:05.123456789Z").alias("created_at"), F.lit("").alias("updated_at"),
    ).write.parquet(path)
    return present(read_budgets(spark, path))


def _stored_times_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.sources.tables import read_pricing

    path = fresh_path(spark, "times")
    fx.stored_times(spark, sf_dir).write.parquet(path)
    return present(read_pricing(spark, path).select("model", "updated_at"))


def _feed_snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as one JSON document, read back and normalised."""
    from tallyspark.sources.feed import read_feed_snapshot

    path = fresh_path(spark, "feed")
    fx.write_feed_document(spark, sf_dir, path)
    return present(PS.normalise_feed(read_feed_snapshot(spark, path), _sync_at()))


def _session_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the session with the highest id."""
    u, rates = _ctx(spark, sf_dir, "events")
    session = u.agg(F.max(F.col("session_id").cast("bigint"))).first()[0]
    return present(R.session_records(u, rates, str(session)))


def _unpriced_without_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _ = _ctx(spark, sf_dir, "events")
    return present(R.unpriced_models(u, fx.rate_sheet(spark).where("model not like 'm-click%'")))


# The last 30 days before fx.AS_OF of the events, stored as days; the second half comes as a later refresh.
EV_30D = UsageFilter(date_from="2023-12-21", date_to="2024-01-19")
EV_30D_SQL = O.where("2023-12-21", "2024-01-20")


def _day_rollup(report: str, **kw) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tallyspark.plans.rollups import DayRollup

        u, rates = _ctx(spark, sf_dir, "events")
        rollup = DayRollup(spark, fresh_path(spark, "day-rollup"))
        rollup.refresh(u.where("usage_date < '2024-01-15' or session_id < '3'"))
        rollup.refresh(u, u.where("usage_date >= '2024-01-15'").select("usage_date").distinct())
        return present(getattr(rollup, report)(rates, **kw))

    return run


def _prefixes(build):
    """Running totals of the events, first without the rows of a day, which come late; then ``build(prefixes, rates)``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tallyspark.plans.prefixes import PrefixTotals
        from tallyspark.plans.rollups import DayRollup

        u, rates = _ctx(spark, sf_dir, "events")
        late = dt.date(2024, 1, 12)
        base = fresh_path(spark, "prefix-totals")
        rollup = DayRollup(spark, base)
        prefixes = PrefixTotals(spark, base, rollup)
        rollup.refresh(u.where(F.col("usage_date") != F.lit(late)))
        prefixes.refresh()
        rollup.refresh(u, u.where(F.col("usage_date") == F.lit(late)).select("usage_date").distinct())
        prefixes.refresh(late)
        return present(build(prefixes, rates))

    return run


# Paths of odd users, found by a gram and a wildcard; one project's slug inside a window.
EV_SEARCH_PATH = UsageFilter(search="/U/_/1")
EV_SEARCH_PATH_SQL = O.where(extra=O.search_filter_sql("/U/_/1"))
EV_SEARCH_WINDOW = UsageFilter(date_from="2024-01-04", date_to="2024-01-16", search="U-3")
EV_SEARCH_WINDOW_SQL = O.where("2024-01-04", "2024-01-17", extra=O.search_filter_sql("U-3"))


def _indexed_search(report: Callable, f: UsageFilter) -> Callable[[SparkSession, str], DataFrame]:
    """A report over stored events whose search is answered by the index, refreshed after each of two loads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tallyspark.plans.search import SearchIndex

        u, rates = _ctx(spark, sf_dir, "events")
        store, index = I.UsageStore(fresh_path(spark, "usage-store")), SearchIndex(spark, fresh_path(spark, "search-index"))
        for where in LATE_FIRST:
            load = u.where(where)
            load.write.mode("append").partitionBy("usage_date").parquet(store.usage)
            index.refresh(load)
        return present(report(*index.narrowed(I.read_usage(spark, store), f), rates))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _report_queries() | _corpus_queries()


def _corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run} if corpus else {}


def _corpus_sql() -> dict[str, str]:
    if not corpus:
        return {}
    return corpus.ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def _report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # S-12, S-14: stored price sheet, late-added column default
        "stored_sheet_older_layout": _stored_sheet_older_layout,
        # M-11: delete records (tombstones + partition compaction)
        "deleted_records_ranking": _deleted_records_ranking,
        # M-13, F-13: budget change set and pinned budgets
        "budget_change_set": _budget_change_set,
        # T-01, T-03, T-04: streaming ingest of landing files
        "stream_ingest_event_logs": _stream_ingest_event_logs,
        # S-11, P-09..P-12, M-05..M-07, M-12, R-13, R-14: price feed and sync
        "price_feed_normalized": _feed_normalized,
        "price_sync_sheet": _sync_sheet,
        "price_sync_counters": _sync_counters,
        "model_ranking_synced_sheet": _ranking_synced,
        # S-01..S-10, M-01..M-04: JSONL ingest round trip
        "ingest_event_logs": _ingest_event_logs,
        # R-07 model ranking (flagship), both views and filtered variants
        "model_ranking": _report("lineitem", R.model_ranking),
        "model_ranking_events": _report("events", R.model_ranking),
        "model_ranking_date_range": _report("lineitem", R.model_ranking, f=LI_RANGE),
        "model_ranking_rfc3339_bounds": _report("lineitem", R.model_ranking, f=LI_RFC),
        "model_ranking_search": _report("events", R.model_ranking, f=EV_SEARCH),
        # F-06: search from a trigram index of the distinct texts
        "model_ranking_indexed_search": _indexed_search(lambda u, f, rates: R.model_ranking(u, rates, f), EV_SEARCH_PATH),
        "summary_indexed_search": _indexed_search(lambda u, f, rates: R.summary(u, rates, f), EV_SEARCH_WINDOW),
        # O-05 / W-01 top-15 rankings with rank position
        "top_models": _report("lineitem", R.top_models),
        "top_projects": _report("lineitem", R.top_projects),
        "top_projects_events": _report("events", R.top_projects),
        # R-01 summary
        "summary": _report("lineitem", R.summary),
        "summary_events": _report("events", R.summary),
        "summary_project": _report("lineitem", R.summary, f=LI_PROJECT),
        "summary_model_filter": _report("events", R.summary, f=EV_MODEL),
        "summary_models": _report("lineitem", R.summary_models),
        # A-01, A-09: distinct sessions from stored day bitmaps
        "summary_30d_bitmaps": _day_rollup("summary", f=EV_30D),
        "project_ranking_bitmaps": _day_rollup("project_ranking"),
        # F-09, R-09: windows as differences of running totals, kept up with late rows
        "summary_30d_prefixes": _prefixes(lambda p, rates: p.summary(rates, EV_30D)),
        "period_comparison_7d_prefixes": _prefixes(lambda p, rates: p.period_comparison(rates, EV_7D, _as_of("events"))),
        # R-02 time series
        "time_series_day": _report("lineitem", R.time_series),
        "time_series_hour": _report("events", R.time_series, bucket="hour"),
        "time_series_by_model": _report("events", R.time_series_models),
        "time_series_7d": _report("events", R.time_series, f=EV_7D),
        # R-03 session page, R-04 records
        "session_page": _report("lineitem", R.session_page),
        "session_page_offset": _report("events", R.session_page, limit="20", offset="7"),
        "session_page_bad_args": _report("events", R.session_page, limit="501", offset="-1"),
        "session_records": _report("events", R.session_records),
        # R-05 filter options
        "filter_projects": _usage_only("events", R.filter_projects),
        "filter_models": _usage_only("events", R.filter_models),
        "filter_projects_lineitem": _usage_only("lineitem", R.filter_projects),
        # R-06 project ranking
        "project_ranking": _report("lineitem", R.project_ranking),
        "project_ranking_events": _report("events", R.project_ranking),
        # R-08 budgets
        "budget_report": _budget("events"),
        "budget_report_lineitem": _budget("lineitem"),
        # R-09 period comparison
        "period_comparison_7d": _comparison("events", EV_7D),
        "period_comparison_all": _comparison("lineitem", UsageFilter()),
        "period_comparison_custom": _comparison("lineitem", LI_RANGE),
        # R-10 metric breakdowns
        "metric_breakdown_cost": _report("lineitem", R.metric_breakdown, metric="cost_usd"),
        "metric_breakdown_output": _report("events", R.metric_breakdown, metric="output_tokens"),
        "metric_breakdown_sessions": _report("lineitem", R.metric_breakdown, metric="sessions"),
        "metric_breakdown_messages": _report("events", R.metric_breakdown, metric="messages"),
        # R-11 / R-12 bucket breakdown and detail
        "bucket_breakdown": _report("events", R.bucket_breakdown),
        "bucket_breakdown_hour": _report("events", R.bucket_breakdown, f=EV_24H, bucket="hour"),
        "bucket_detail": _report("lineitem", R.bucket_detail),
        # R-15 unpriced models, P-07/P-08 candidate matching
        "unpriced_models": _report("lineitem", R.unpriced_models),
        "unpriced_models_events": _unpriced_without_click,
        "session_drilldown": _session_drilldown,
        "bucket_drilldown_day": _report("events", R.bucket_breakdown, bucket="day", bucket_value="2024-01-10"),
        "bucket_drilldown_hour": _report("events", R.bucket_breakdown, bucket="hour", bucket_value="2024-01-10 05:00:00"),
        "live_bucket_totals": _live_bucket_totals,
        # T-06, M-11: totals follow deletes
        "live_totals_after_delete": _live_totals_after_delete,
        # S-09, S-10: reading from saved offsets; truncation
        "ingest_grown_logs": _ingest_grown_logs,
        "ingest_grown_lines": _ingest_grown_lines,
        "ingest_truncated_logs": _ingest_truncated_logs,
        # T-01: appended lines through a stream
        "tail_event_logs": _tail_event_logs,
        "ingest_late_batch": _ingest_late_batch,
        "ingest_odd_names": _ingest_odd_names,
        "ingest_lines": _ingest_lines,
        "ingest_quarantine": _ingest_quarantine,
        "ingest_manifest": _ingest_manifest,
        "rate_change_set": _rate_change_set,
        "stored_budgets": _stored_budgets,
        "stored_times_text": _stored_times_text,
        "feed_snapshot_json": _feed_snapshot_json,
        "model_rate_matches": _report("events", R.model_rate_matches),
        "model_rate_matches_lineitem": _report("lineitem", R.model_rate_matches),
    }


def oracle_sql() -> dict[str, str]:
    return _report_sql() | _corpus_sql()


def _report_sql() -> dict[str, str]:
    return {
        "stored_sheet_older_layout": O.synced_sheet(fx.SYNC_AT, source="manual"),
        "deleted_records_ranking": O.model_ranking("events", O.where(extra="COALESCE(git_branch, '') <> 'click'")),
        "budget_change_set": O.budget_change_set("events", _month_start_text("events")),
        "stream_ingest_event_logs": O.ingested_event_logs(),
        "price_feed_normalized": O.normalized_feed(fx.SYNC_AT),
        "price_sync_sheet": O.synced_sheet(fx.SYNC_AT),
        "price_sync_counters": O.sync_counters(fx.SYNC_AT),
        "model_ranking_synced_sheet": O.model_ranking_synced("lineitem", fx.SYNC_AT),
        "ingest_event_logs": O.ingested_event_logs(),
        "model_ranking": O.model_ranking("lineitem"),
        "model_ranking_events": O.model_ranking("events"),
        "model_ranking_date_range": O.model_ranking("lineitem", LI_RANGE_SQL),
        "model_ranking_rfc3339_bounds": O.model_ranking("lineitem", LI_RFC_SQL),
        "model_ranking_search": O.model_ranking("events", EV_SEARCH_SQL),
        "model_ranking_indexed_search": O.model_ranking("events", EV_SEARCH_PATH_SQL),
        "summary_indexed_search": O.summary("events", EV_SEARCH_WINDOW_SQL),
        "top_models": O.top_models("lineitem"),
        "top_projects": O.top_projects("lineitem"),
        "top_projects_events": O.top_projects("events"),
        "summary": O.summary("lineitem"),
        "summary_events": O.summary("events"),
        "summary_project": O.summary("lineitem", LI_PROJECT_SQL),
        "summary_model_filter": O.summary("events", EV_MODEL_SQL),
        "summary_models": O.model_ranking("lineitem"),
        "summary_30d_bitmaps": O.summary("events", EV_30D_SQL),
        "project_ranking_bitmaps": O.project_ranking("events"),
        "summary_30d_prefixes": O.summary("events", EV_30D_SQL),
        "period_comparison_7d_prefixes": O.period_comparison(
            "events", ("2024-01-13", None), ("2024-01-06", "2024-01-13"), "vs previous 7 days"
        ),
        "time_series_day": O.time_series("lineitem", "day"),
        "time_series_hour": O.time_series("events", "hour"),
        "time_series_by_model": O.time_series_models("events", "day"),
        "time_series_7d": O.time_series("events", "day", EV_7D_SQL),
        "session_page": O.session_page("lineitem", 50, 0),
        "session_page_offset": O.session_page("events", 20, 7),
        "session_page_bad_args": O.session_page("events", 50, 0),
        "session_records": O.session_records("events"),
        "filter_projects": O.filter_projects("events"),
        "filter_models": O.filter_models("events"),
        "filter_projects_lineitem": O.filter_projects("lineitem"),
        "project_ranking": O.project_ranking("lineitem"),
        "project_ranking_events": O.project_ranking("events"),
        "budget_report": O.budget_report("events", _month_start_text("events")),
        "budget_report_lineitem": O.budget_report("lineitem", _month_start_text("lineitem")),
        "period_comparison_7d": O.period_comparison(
            "events", ("2024-01-13", None), ("2024-01-06", "2024-01-13"), "vs previous 7 days"
        ),
        "period_comparison_all": O.period_comparison(
            "lineitem", ("2001-11-01", None), ("2001-10-01", "2001-11-01"), "vs last month"
        ),
        "period_comparison_custom": O.period_comparison(
            "lineitem", ("1996-01-01", "1998-01-01"), ("1994-01-01", "1996-01-01"), "vs previous 730 days"
        ),
        "metric_breakdown_cost": O.metric_breakdown("lineitem", "cost_usd"),
        "metric_breakdown_output": O.metric_breakdown("events", "output_tokens"),
        "metric_breakdown_sessions": O.metric_breakdown("lineitem", "sessions"),
        "metric_breakdown_messages": O.metric_breakdown("events", "messages"),
        "bucket_breakdown": O.bucket_breakdown("events", "day"),
        "bucket_breakdown_hour": O.bucket_breakdown("events", "hour", EV_24H_SQL),
        "bucket_detail": O.bucket_detail("lineitem", "day"),
        "unpriced_models": O.unpriced_models("lineitem"),
        "unpriced_models_events": O.unpriced_models("events", without="m-click"),
        "session_drilldown": O.session_records("events", "(SELECT CAST(max(user_id) AS VARCHAR) FROM events)"),
        "bucket_drilldown_day": O.bucket_breakdown("events", "day", O.where("2024-01-10", "2024-01-11")),
        "bucket_drilldown_hour": O.bucket_breakdown("events", "hour", O.where(extra="strftime(ts, '%Y-%m-%d %H') = '2024-01-10 05'")),
        "live_bucket_totals": O.live_totals(),
        "live_totals_after_delete": O.live_totals("git_branch <> 'click'"),
        "ingest_grown_logs": O.ingested_event_logs(),
        "ingest_grown_lines": O.numbered_lines(),
        "ingest_truncated_logs": O.ingested_event_logs(),
        "tail_event_logs": O.ingested_event_logs(),
        "ingest_late_batch": O.ingested_event_logs(),
        "ingest_odd_names": O.odd_names(),
        "ingest_lines": O.numbered_lines(),
        "ingest_quarantine": O.quarantined(),
        "ingest_manifest": O.manifest_lines(),
        "rate_change_set": O.rate_change_set(),
        "stored_budgets": O.stored_budgets(),
        "stored_times_text": O.stored_times(),
        "feed_snapshot_json": O.normalized_feed(fx.SYNC_AT),
        "model_rate_matches": O.model_rate_matches("events"),
        "model_rate_matches_lineitem": O.model_rate_matches("lineitem"),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: model ranking (cost with fallback rate matching) at sf0.001."""
    return queries()["model_ranking"](spark, SMOKE_DIR)
