"""Usage fact views derived from the driver's tables (see FIXTURES.md §3).

Both views are plain projections with the fact-table schema, so every report
runs on them unchanged and DuckDB can run the same definitions in SQL.

``usage_from_lineitem`` is the large one: line items are de-duplicated by
their message id (order key + line number, first by part and supplier key)
*before* the dimension joins.  The de-duplication is an aggregate with
``min_by``, which combines map-side: a message id holding a third of all
rows is reduced inside every map task and never lands whole in one task.
The joins that follow are left to Catalyst/AQE (broadcast when the runtime
size allows, sort-merge with skew splitting otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import project_key
from ..schemas import PRICING, RATE_COLUMNS, SOURCE_FEED, SOURCE_MANUAL, SOURCE_SEED, SYNTHETIC_MODEL, USAGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _finish(df: DataFrame) -> DataFrame:
    """Add the materialised columns and order fields as the fact schema."""
    out = df.withColumn("project_key", project_key()).withColumn("usage_date", F.to_date("ts"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE.fields])


def _s(c: Column) -> Column:
    return c.cast("string")


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # One row per message id: the line with the smallest (partkey, suppkey).
    keep = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    first = (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min_by(keep, F.struct("l_partkey", "l_suppkey")).alias("r"))
        .select("l_orderkey", "l_linenumber", "r.*")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    j = (
        first.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    df = j.select(
        F.concat(_s(F.col("l_orderkey")), F.lit("-"), _s(F.col("l_linenumber"))).alias("message_id"),
        F.lit(None).cast("string").alias("request_id"),
        _s(F.col("l_orderkey")).alias("session_id"),
        F.concat(F.lit("-seg-"), F.lower("c_mktsegment")).alias("project_slug"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/seg/"), _s(F.col("c_nationkey"))))
        .alias("cwd"),
        F.col("o_orderpriority").alias("git_branch"),
        F.concat(F.lower("p_type"), F.lit("-4-"), _s(F.col("p_size") % 5)).alias("model"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.floor("l_quantity").cast("bigint").alias("input_tokens"),
        F.floor("l_extendedprice").cast("bigint").alias("output_tokens"),
        (F.col("l_partkey") % 1000).cast("bigint").alias("cache_creation_tokens"),
        F.col("l_suppkey").cast("bigint").alias("cache_read_tokens"),
        F.lit("lineitem").alias("source_file"),
        F.col("l_linenumber").cast("bigint").alias("source_line"),
    )
    return _finish(df)


# --- fixed values -----------------------------------------------------------
# Model id written for each event type of the events table.
EVENT_MODELS = {
    "error": SYNTHETIC_MODEL,
    "click": "m-click-4-5-20240101",
    "signup": "m-signup-20240101",
    "purchase": "m-purchase-3-5-1",
}
# view events alternate between two point releases by user parity.
VIEW_MODEL_PREFIX = "m-view-4-"
# ---------------------------------------------------------------------------


def event_model(event_type: Column, user_id: Column) -> Column:
    expr = F.when(event_type == "view", F.concat(F.lit(VIEW_MODEL_PREFIX), _s(6 + user_id % 2)))
    for et, model in EVENT_MODELS.items():
        expr = expr.when(event_type == et, F.lit(model))
    return expr.otherwise(F.concat(F.lit("m-"), event_type))


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    df = ev.select(
        _s(F.col("event_id")).alias("message_id"),
        F.lit(None).cast("string").alias("request_id"),
        _s(uid).alias("session_id"),
        F.concat(F.lit("-u-"), _s(uid % 7)).alias("project_slug"),
        F.when(uid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/u/"), _s(uid % 7), F.lit("/"), _s(uid % 2))).alias("cwd"),
        F.when(F.col("event_type") == "view", F.lit("HEAD")).otherwise(F.col("event_type")).alias("git_branch"),
        event_model(F.col("event_type"), uid).alias("model"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.floor("value").cast("bigint"), F.lit(0)).alias("output_tokens"),
        (F.col("event_id") % 1000).alias("cache_creation_tokens"),
        (F.col("event_id") % 7919).alias("cache_read_tokens"),
        F.lit("events").alias("source_file"),
        F.col("event_id").alias("source_line"),
    )
    return _finish(df)


USAGE_VIEWS = {"lineitem": usage_from_lineitem, "events": usage_from_events}

# --- fixed values -----------------------------------------------------------
# Test rate sheet: exact ids, family ids reached by the fallback walk, and
# models left without any rate.  (model, input, output, cache write, cache
# read, source) in USD per million tokens.
RATE_SHEET = [
    ("economy-4-1", 3.0, 15.0, 3.75, 0.3, SOURCE_MANUAL),
    ("economy-4", 1.0, 5.0, 1.25, 0.1, SOURCE_FEED),
    ("large-4-3", 15.0, 75.0, 18.75, 1.5, SOURCE_SEED),
    ("medium-4", 0.8, 4.0, 1.0, 0.08, SOURCE_FEED),
    ("standard-4-2", 2.5, 10.0, 3.125, 0.25, SOURCE_MANUAL),
    ("standard-4", 0.5, 2.5, 0.625, 0.05, SOURCE_FEED),
    ("m-click-4-5", 3.0, 15.0, 3.75, 0.3, SOURCE_FEED),
    ("m-view-4", 1.0, 5.0, 1.25, 0.1, SOURCE_SEED),
    ("m-signup", 0.25, 1.25, 0.3, 0.03, SOURCE_MANUAL),
    ("m-purchase-3", 15.0, 75.0, 18.75, 1.5, SOURCE_FEED),
    ("m-purchase", 9.0, 9.0, 9.0, 9.0, SOURCE_FEED),
    (SYNTHETIC_MODEL, 100.0, 100.0, 100.0, 100.0, SOURCE_MANUAL),
]
# Test budgets: (id, name, amount_usd, show_in_dashboard).
BUDGETS = [
    (1, "team", 500.0, True),
    (2, "tiny", 0.5, True),
    (3, "unset", 0.0, False),
    (4, "large", 1000000.0, None),
]
# "now" for presets and month-to-date spend, per view (UTC wall clock).
AS_OF = {"lineitem": "2001-11-04 00:00:00", "events": "2024-01-20 12:00:00"}
# ---------------------------------------------------------------------------


def rate_sheet(spark: SparkSession) -> DataFrame:
    rows = [(m, i, o, w, r, s, None, None) for (m, i, o, w, r, s) in RATE_SHEET]
    return spark.createDataFrame(rows, PRICING)


def bounded_rate_sheet(spark: SparkSession):
    """The test sheet with its row count known up front (no sizing job)."""
    from ..operators.rates import RateSheet

    return RateSheet(rate_sheet(spark), known_rows=len(RATE_SHEET))


def budgets(spark: SparkSession) -> DataFrame:
    from ..schemas import BUDGETS as BUDGET_SCHEMA

    rows = [(i, n, a, s, None, None) for (i, n, a, s) in BUDGETS]
    return spark.createDataFrame(rows, BUDGET_SCHEMA)


# --- JSONL session logs derived from the events table ----------------------
# Each event becomes one log line under <root>/p=<slug>/ (the directory
# written by partitionBy, so the project slug read back is "p=<slug>").
# signup events are written as user lines (not usage); every 10th usage event
# is repeated under p=~replay with other counters (the first copy in walk
# order must win); every 50th event also gets a malformed line and a blank
# line next to it.
LOG_PARTITION = "p"
REPLAY_DIR = "~replay"
# Added to folder names by write_odd_names; the writer escapes some of it with "%".
ODD_NAME = " a+b [1]{x}%41"


def event_log_lines(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    ev = table(spark, sf_dir, "events").where(where)
    uid, eid = F.col("user_id"), F.col("event_id")
    usage = F.struct(
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.floor("value").cast("bigint"), F.lit(0)).alias("output_tokens"),
        (eid % 1000).alias("cache_creation_input_tokens"),
        (eid % 7919).alias("cache_read_input_tokens"),
    )

    def line(u):
        return F.to_json(
            F.struct(
                F.when(F.col("event_type") == "signup", F.lit("user")).otherwise(F.lit("assistant")).alias("type"),
                F.when(eid % 2 == 1, F.concat(F.lit("req-"), _s(eid))).otherwise(F.lit("")).alias("requestId"),
                _s(uid).alias("sessionId"),
                F.when(uid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/u/"), _s(uid % 7), F.lit("/"), _s(uid % 2))).alias("cwd"),
                F.when(F.col("event_type") == "view", F.lit("HEAD")).otherwise(F.col("event_type")).alias("gitBranch"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                F.struct(_s(eid).alias("id"), event_model(F.col("event_type"), uid).alias("model"), u.alias("usage")).alias("message"),
            )
        )

    slug = F.concat(F.lit("-u-"), _s(uid % 7))
    main = ev.select(slug.alias(LOG_PARTITION), line(usage).alias("value"))
    replay_usage = usage.withField("output_tokens", usage.getField("output_tokens") + 1)
    replay = ev.filter((eid % 10 == 0) & (F.col("event_type") != "signup")).select(
        F.lit(REPLAY_DIR).alias(LOG_PARTITION), line(replay_usage).alias("value")
    )
    junk = ev.filter(eid % 50 == 0).select(
        slug.alias(LOG_PARTITION),
        F.explode(F.array(F.concat(F.lit('{"type":"assistant","message":{"id":'), _s(eid)), F.lit(""))).alias("value"),
    )
    return main.unionByName(replay).unionByName(junk)


def write_event_logs(spark: SparkSession, sf_dir: str, root: str, where: str = "true") -> None:
    event_log_lines(spark, sf_dir, where).write.mode("append").partitionBy(LOG_PARTITION).text(root)


def write_odd_names(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The same logs in folders whose names hold spaces, signs and percent escapes."""
    name = F.concat(F.col(LOG_PARTITION), F.lit(ODD_NAME))
    event_log_lines(spark, sf_dir).withColumn(LOG_PARTITION, name).write.partitionBy(LOG_PARTITION).text(root)


def write_numbered_logs(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One file for 5000 event ids, its lines in event order; a line's request id is its number in the file."""
    eid = F.col("event_id")
    ev = table(spark, sf_dir, "events").select(F.floor(eid / 5000).alias(LOG_PARTITION), eid, "ts")
    n = F.row_number().over(Window.partitionBy(LOG_PARTITION).orderBy("event_id"))
    usage = F.struct(F.lit(1).alias("input_tokens"))
    line = F.to_json(
        F.struct(
            F.lit("assistant").alias("type"),
            _s(n).alias("requestId"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.struct(_s(eid).alias("id"), F.lit("m-1").alias("model"), usage.alias("usage")).alias("message"),
        )
    )
    lines = ev.select(LOG_PARTITION, n.alias("n"), line.alias("value"))
    files = lines.repartition(LOG_PARTITION).sortWithinPartitions(LOG_PARTITION, "n").drop("n")
    files.write.partitionBy(LOG_PARTITION).text(root)


def copy_logs(spark: SparkSession, source: str, target: str, share: float, glob: str = "*.txt") -> None:
    """The first ``share`` of each log file's bytes, under the same name below ``target``: files as a writer leaves them while they grow.

    Replays come with the whole files only: of two runs the earlier one's copy of a message stays.
    """
    import pyarrow as pa

    from ..plans.ingest import list_files
    from ..sources.logs import root_path
    from ..sources.ranges import BLOCK, dealt, filesystem

    source, target = root_path(source), root_path(target)

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column("source_file").to_pylist(), batch.column("length").to_pylist(), strict=True):
                where, name = filesystem(path)
                copy = target + name.removeprefix(source)
                where.create_dir(copy.rsplit("/", 1)[0])
                with where.open_input_file(name) as old, where.open_output_stream(copy) as new:
                    left = int(size * share)
                    while left and (data := old.read(min(left, BLOCK))):
                        new.write(data)
                        left -= len(data)
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["source_file"])

    files = list_files(spark, source, glob).select("source_file", "length")
    if share < 1:
        files = files.where(~F.col("source_file").contains(f"/{LOG_PARTITION}={REPLAY_DIR}/"))
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    dealt(files, n, size).mapInArrow(run, "source_file string").write.format("noop").mode("overwrite").save()


# --- provider feed derived from the part table ------------------------------
# One feed entry per (p_type, p_size) group; pos = p_size decides which of
# two entries meeting on one model id is later.  Sizes pick the edge cases:
# other vendor (size % 10 = 9), variant ids (size % 10 = 7), empty prompt
# (size % 13 = 0), unparseable prompt (size % 17 = 0), zero completion
# (size % 11 = 0), no cache read price (size % 3 = 0), no cache write price
# (size % 4 = 0).
OTHER_VENDOR = "other/"
VARIANT_SUFFIX = ":thinking"
SYNC_AT = "2024-01-20 12:00:00"


def feed_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feed import FEED_COLUMNS
    from ..functions.feed import VENDOR_PREFIX

    part = table(spark, sf_dir, "part")
    g = part.groupBy("p_type", "p_size").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")
    )
    size = F.col("p_size")
    vendor = F.when(size % 10 == 9, F.lit(OTHER_VENDOR)).otherwise(F.lit(VENDOR_PREFIX))
    variant = F.when(size % 10 == 7, F.lit(VARIANT_SUFFIX)).otherwise(F.lit(""))
    return g.select(
        size.cast("bigint").alias("pos"),
        F.concat(vendor, F.lower("p_type"), F.lit("-4."), _s(size % 5), variant).alias("id"),
        F.when(size % 13 == 0, F.lit("")).when(size % 17 == 0, F.lit("n/a"))
        .otherwise(F.concat(_s(F.col("lo") % 20), F.lit("e-7"))).alias("prompt"),
        F.when(size % 11 == 0, F.lit("0")).otherwise(F.concat(_s(F.col("n") % 50 + 1), F.lit("e-7"))).alias("completion"),
        F.when(size % 3 == 0, F.lit("")).otherwise(F.concat(_s(F.col("hi") % 7), F.lit("e-8"))).alias("input_cache_read"),
        F.when(size % 4 == 0, F.lit("")).otherwise(F.concat(_s(F.col("hi") % 9 + 1), F.lit("e-7"))).alias("input_cache_write"),
    ).select(*FEED_COLUMNS)


def write_feed_document(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The part-derived feed as the provider's JSON document, entries in feed order."""
    price = F.struct("prompt", "completion", "input_cache_read", "input_cache_write")
    entry = F.struct("id", price.alias("pricing"), "pos")
    feed = feed_from_part(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("pos", "id", entry.alias("e")))).alias("x"))
    feed.select(F.transform("x", lambda e: e["e"].dropFields("pos")).alias("data")).write.json(path)


# Layouts that stored times are written in, by event_id % 6 (the last is no time).
def stored_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price row an event, its updated_at as text in one of the stored layouts."""
    ts = F.col("ts").cast("timestamp_ntz")
    t, d = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(t, F.lit("789Z")))
        .when(kind == 1, F.concat(t, F.lit("Z")))
        .when(kind == 2, F.concat(d, F.lit("7+02:00")))
        .when(kind == 3, F.concat(d, F.lit("789")))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("yesterday"))
    )
    rates = [F.lit(1.0).alias(c) for c in RATE_COLUMNS]
    return table(spark, sf_dir, "events").select(_s(F.col("event_id")).alias("model"), *rates, text.alias("updated_at"))
