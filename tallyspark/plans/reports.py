"""Reports: compositions of filters, aggregates, rate lookup and ordering.

Inputs are a usage DataFrame with the fact schema (a stored table or a derived
view) and a rate sheet.  Reports with one branch are lazy DataFrames; reports
that read their fine aggregate several times stage it once in the shared folder,
so the facts are scanned once and every branch sees the same rows.  Only one-row results and bounded pages are ever broadcast; all
other joins are between post-aggregation results and are planned by AQE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.cost import token_total
from ..functions.filters import UsageFilter, month_start, page_args, previous_period, session_predicate
from ..operators import aggregates as A
from ..operators.rates import RateSheet, as_sheet, price_groups, price_rows, sum_tokens
from ..operators.ranking import order_top, rank_index
from ..schemas import RATE_COLUMNS, TOKEN_COLUMNS
from ..sources.tables import staged

MEASURES = TOKEN_COLUMNS + ["messages"]
TOP_N = 15


def _filtered(u: DataFrame, f: UsageFilter | None) -> DataFrame:
    return u.filter((f or UsageFilter()).predicate())


def _sums(prefix: str = "") -> list:
    """Roll-up of pre-aggregated token sums and message counts (0 when empty)."""
    return [F.coalesce(F.sum(prefix + c), F.lit(0)).cast("bigint").alias(c) for c in MEASURES]


def fine(u: DataFrame, f: UsageFilter | None, keys: list[str]) -> DataFrame:
    """The one aggregate a report reads: token sums and messages per ``keys``.

    Where branches of a report read different columns of it, pruning makes
    their plans differ and each would scan the facts again: such reports stage it.
    """
    return _filtered(u, f).groupBy(*keys).agg(*sum_tokens(), F.count(F.lit(1)).alias("messages"))


def _summary_from(fine_df: DataFrame, sheet: RateSheet) -> DataFrame:
    """One summary row from a fine aggregate that has model and session_id keys."""
    per_model = fine_df.groupBy("model").agg(*_sums())
    cost = price_groups(per_model, [], sheet).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)))
    totals = fine_df.agg(*_sums(), F.countDistinct("session_id").alias("sessions"))
    # The cost total is one value: attached as a scalar subquery, not a join.
    return totals.select(*TOKEN_COLUMNS, "sessions", "messages", cost.scalar().alias("cost_usd"))


def priced_models(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    """Per-model totals with matched rate and cost (A-02 + J-02 + P-04)."""
    return price_groups(fine(u, f, ["model"]), [], as_sheet(rates))


# R-07 ----------------------------------------------------------------------
def model_ranking(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    pm = priced_models(u, rates, f)
    return pm.select("model", *MEASURES, "cost_usd").orderBy(F.desc("cost_usd"), F.asc("model"))


def top_models(u: DataFrame, rates, f: UsageFilter | None = None, k: int = TOP_N) -> DataFrame:
    """The first ``k`` of the model ranking with their 1-based rank."""
    order = [F.desc("cost_usd"), F.asc("model")]
    pm = priced_models(u, rates, f).select("model", *MEASURES, "cost_usd")
    return rank_index(order_top(pm, order, k), order)


# R-01 ----------------------------------------------------------------------
def summary(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    """One row: token sums, distinct sessions, messages and total cost.

    Totals, distinct sessions and the per-model cost all roll up from one
    (model, session_id) aggregate.
    """
    return _summary_from(fine(u, f, ["model", "session_id"]), as_sheet(rates))


def summary_models(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    """The per-model list of the summary, ordered by model."""
    return priced_models(u, rates, f).select("model", *MEASURES, "cost_usd").orderBy("model")


# R-02 ----------------------------------------------------------------------
def _bucket_models(u: DataFrame, f: UsageFilter | None, bucket: str, sheet: RateSheet) -> DataFrame:
    return price_groups(A.time_series_by_model(_filtered(u, f), bucket), ["bucket"], sheet)


def time_series(u: DataFrame, rates, f: UsageFilter | None = None, bucket: str = "day") -> DataFrame:
    """bucket key, four token sums and cost; buckets without rows are absent.

    One (bucket, model) aggregate is priced and rolled up, so tokens and
    cost come from a single scan.
    """
    bm = _bucket_models(u, f, bucket, as_sheet(rates))
    return (
        bm.groupBy("bucket")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLUMNS], F.sum("cost_usd").alias("cost_usd"))
        .orderBy("bucket")
    )


def time_series_models(u: DataFrame, rates, f: UsageFilter | None = None, bucket: str = "day") -> DataFrame:
    bm = _bucket_models(u, f, bucket, as_sheet(rates))
    return bm.select("bucket", "model", *TOKEN_COLUMNS, "cost_usd").orderBy("bucket", "model")


# R-03 ----------------------------------------------------------------------
def session_page(u: DataFrame, rates, f: UsageFilter | None = None, limit=None, offset=None, after=None) -> DataFrame:
    """A page of session rows (last seen first) with cost and the total count.

    Everything rolls up from one staged (session_id, project_slug, model)
    aggregate: the session rows, the group count and the page's cost, so the
    facts are scanned once.  The page is at most 500 rows by construction, so
    it is broadcast for the semi-join that restricts pricing to its sessions.
    Cost is keyed by session id only: a session seen under two slugs shows
    the combined cost on both rows.

    ``after`` -- the (last_seen, session_id, project_slug) of the last row
    shown -- continues from there at the same cost for any depth; ``offset``
    sorts all rows up to the page.
    """
    lim, off = page_args(limit, offset)
    sheet = as_sheet(rates)
    g = _filtered(u, f).groupBy("session_id", "project_slug", "model").agg(
        *sum_tokens(),
        F.count(F.lit(1)).alias("messages"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max("cwd").alias("cwd"),
        F.max("git_branch").alias("git_branch"),
    )
    g = staged(g, "session-page")
    order = [F.desc("last_seen"), F.asc("session_id"), F.asc("project_slug")]
    rows = g.groupBy("session_id", "project_slug").agg(
        F.coalesce(F.max("cwd"), F.lit("")).alias("cwd"),
        F.coalesce(F.max("git_branch"), F.lit("")).alias("git_branch"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *_sums(),
    )
    if after is not None:
        seen, sid, slug = after
        later = (F.col("session_id") > sid) | ((F.col("session_id") == sid) & (F.col("project_slug") > slug))
        seen = F.lit(seen).cast("timestamp_ntz")
        rows = rows.filter((F.col("last_seen") < seen) | ((F.col("last_seen") == seen) & later))
    page = rows.orderBy(*order).offset(off).limit(lim)
    ids = page.select("session_id").distinct()
    cost = (
        price_groups(g.join(F.broadcast(ids), "session_id", "left_semi"), ["session_id", "project_slug"], sheet)
        .groupBy("session_id")
        .agg(F.sum("cost_usd").alias("cost_usd"))
    )
    total = g.select("session_id", "project_slug").distinct().agg(F.count(F.lit(1)))
    out = (
        page.join(cost, "session_id", "left")
        .withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
        .withColumn("has_branch", S.has_branch(F.col("git_branch")))
        .withColumn("cache_total", S.cache_total())
        .withColumn("total", total.scalar())
        .withColumn("page_limit", F.lit(lim).cast("bigint"))
        .withColumn("page_offset", F.lit(off).cast("bigint"))
    )
    return out.orderBy(*order)


# R-04 ----------------------------------------------------------------------
def session_records(u: DataFrame, rates, session_id: str | None = None) -> DataFrame:
    """Message rows with per-row cost, oldest first.

    With ``session_id`` this is the drill-down of one session (stored files
    are sorted by session, so their statistics prune it); without it every
    non-synthetic record is listed.
    """
    rows = staged(u.filter(session_predicate(session_id)), "session") if session_id is not None else _filtered(u, None)
    priced = price_rows(rows, as_sheet(rates))
    return priced.select(
        "message_id",
        "session_id",
        "ts",
        "model",
        F.coalesce("git_branch", F.lit("")).alias("git_branch"),
        *TOKEN_COLUMNS,
        "source_file",
        "source_line",
        "cost_usd",
        S.has_branch(F.col("git_branch")).alias("has_branch"),
        S.cache_total().alias("cache_total"),
    ).orderBy("ts", "message_id")


# R-05 ----------------------------------------------------------------------
def filter_projects(u: DataFrame) -> DataFrame:
    return A.distinct_projects(u).orderBy("project_key")


def filter_models(u: DataFrame) -> DataFrame:
    return A.distinct_models(u).orderBy("model")


# R-06 ----------------------------------------------------------------------
def _projects_from(g: DataFrame, sheet: RateSheet) -> DataFrame:
    """Project rows from a staged (project_key, model, session_id) aggregate."""
    pm = price_groups(g.groupBy("project_key", "model").agg(*_sums()), ["project_key"], sheet)
    projects = A.project_rollup(pm)
    sessions = g.groupBy("project_key").agg(F.countDistinct("session_id").alias("sessions"))
    return (
        projects.join(sessions, "project_key", "left")
        .withColumn("sessions", F.coalesce("sessions", F.lit(0)))
        .select("project_key", "models", *MEASURES, "sessions", "cost_usd")
    )


def project_ranking(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    """Per project key: totals, sorted model list, distinct sessions, cost."""
    g = staged(fine(u, f, ["project_key", "model", "session_id"]), "project-ranking")
    return _projects_from(g, as_sheet(rates)).orderBy(F.desc("cost_usd"), F.asc("project_key"))


def top_projects(u: DataFrame, rates, f: UsageFilter | None = None, k: int = TOP_N) -> DataFrame:
    """The first ``k`` of the project ranking with their 1-based rank."""
    order = [F.desc("cost_usd"), F.asc("project_key")]
    g = staged(fine(u, f, ["project_key", "model", "session_id"]), "project-ranking")
    return rank_index(order_top(_projects_from(g, as_sheet(rates)), order, k), order)


# R-08 ----------------------------------------------------------------------
def month_spend(u: DataFrame, rates, as_of: dt.datetime) -> DataFrame:
    """One row: cost since the UTC month start of ``as_of``, all projects and models."""
    start = month_start(as_of).strftime("%Y-%m-%d")
    return priced_models(u, rates, UsageFilter(date_from=start)).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd")
    )


def month_spend_value(u: DataFrame, rates, as_of: dt.datetime):
    """The month-to-date spend as a scalar-subquery Column (computed once)."""
    return month_spend(u, rates, as_of).scalar()


def budget_report(u: DataFrame, rates, budgets: DataFrame, as_of: dt.datetime, pinned_only: bool = False) -> DataFrame:
    b = budgets.withColumn("show_in_dashboard", F.coalesce("show_in_dashboard", F.lit(False)))
    if pinned_only:
        b = b.filter(F.col("show_in_dashboard"))
    pct = S.budget_pct_used(F.col("spent_usd"), F.col("amount_usd"))
    return (
        b.withColumn("spent_usd", month_spend_value(u, rates, as_of))
        .withColumn("pct_used", pct)
        .withColumn("status", S.budget_status(F.col("pct_used")))
        .withColumn("bar_pct", S.budget_bar_pct(F.col("pct_used")))
        .select("id", "name", "amount_usd", "show_in_dashboard", "spent_usd", "pct_used", "status", "bar_pct")
        .orderBy("id")
    )


# R-09 ----------------------------------------------------------------------
COMPARED = ["cost_usd", "sessions", "messages"] + TOKEN_COLUMNS


def period_comparison(u: DataFrame, rates, f: UsageFilter | None, as_of: dt.datetime) -> DataFrame | None:
    """Seven metrics of the current window against the window before it.

    Returns None when the current window has no length.  The current side
    is the dashboard summary (its own from/to), except for "all time",
    where both sides are calendar months.  One scan: rows are flagged per
    window (a row may fall in both when the bounds overlap by a day) and a
    single staged (model, session_id) aggregate sums each window conditionally.
    """
    f = f or UsageFilter()
    cmp = previous_period(f.date_from, f.date_to, as_of)
    if cmp is None:
        return None
    sheet = as_sheet(rates)
    cur_f = f.with_bounds(cmp.current_from, cmp.current_to)
    prev_f = f.with_bounds(cmp.previous_from, cmp.previous_to)
    flagged = u.filter(cur_f.predicate() | prev_f.predicate()).select(
        "model", "session_id", *TOKEN_COLUMNS,
        cur_f.predicate().alias("_cur"), prev_f.predicate().alias("_prev"),
    )
    aggs = []
    for side in ("cur", "prev"):
        flag = F.col("_" + side)
        aggs += [F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).alias(f"{side}_{c}") for c in TOKEN_COLUMNS]
        aggs.append(F.count_if(flag).alias(f"{side}_messages"))
    g = staged(flagged.groupBy("model", "session_id").agg(*aggs), "comparison")

    def side_summary(side: str) -> DataFrame:
        part = g.filter(F.col(f"{side}_messages") > 0).select(
            "model", "session_id", *[F.col(f"{side}_{c}").alias(c) for c in MEASURES]
        )
        return _summary_from(part, sheet)

    return compared(side_summary("cur"), side_summary("prev"), cmp.label)


def compared(current: DataFrame, previous: DataFrame, label: str) -> DataFrame:
    """One row a metric from the one-row summaries of two windows."""
    # Each side is one row; read as struct-valued scalar subqueries.
    cur = current.select(F.struct(*COMPARED)).scalar()
    prev = previous.select(F.struct(*COMPARED)).scalar()
    metrics = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                cur.getField(c).cast("double").alias("current"),
                prev.getField(c).cast("double").alias("previous"),
            )
            for c in COMPARED
        ]
    )
    both = current.sparkSession.range(1)
    out = both.select(F.inline(metrics)).withColumn("pct_change", S.pct_change(F.col("current"), F.col("previous")))
    return out.withColumn("direction", S.change_direction(F.col("pct_change"))).withColumn("label", F.lit(label))


# R-10 ----------------------------------------------------------------------
CARDS = ["cost_usd", *TOKEN_COLUMNS, "sessions", "messages"]


def metric_breakdown(u: DataFrame, rates, metric: str, f: UsageFilter | None = None) -> DataFrame:
    """Top 15 contributors to one summary card, with their share.

    Sessions and messages break down by project (label = project path),
    every other card by model.  The share's denominator is the card total,
    else the sum of the rows, else 1.  Rows and card roll up from the same
    staged aggregate; cost and token cards need models only, and are the sum
    of their rows.
    """
    if metric not in CARDS:
        raise ValueError(f"unknown metric {metric!r}")
    sheet = as_sheet(rates)
    if metric in ("sessions", "messages"):
        g = staged(fine(u, f, ["project_key", "model", "session_id"]), "breakdown")
        src = _projects_from(g, sheet).select(
            S.slug_to_path(F.col("project_key")).alias("label"), F.col(metric).cast("double").alias("value")
        )
    else:
        g = None
        per_model = price_groups(fine(u, f, ["model"]), [], sheet)
        src = per_model.select(F.col("model").alias("label"), F.col(metric).cast("double").alias("value"))
        src = staged(src, "breakdown")
    card = _summary_from(g, sheet).select(F.col(metric).cast("double")).scalar() if g is not None else F.lit(None).cast("double")
    row_sum = src.agg(F.coalesce(F.sum("value"), F.lit(0.0))).scalar()
    total = F.coalesce(F.nullif(card, F.lit(0.0)), F.nullif(row_sum, F.lit(0.0)), F.lit(1.0))
    top = order_top(src.filter(F.col("value") > 0), [F.desc("value"), F.asc("label")], TOP_N)
    out = top.withColumn("share_pct", F.col("value") / total * 100.0)
    return rank_index(out.select("label", "value", "share_pct"), [F.desc("value"), F.asc("label")])


# R-11 ----------------------------------------------------------------------
def bucket_breakdown(u: DataFrame, rates, f: UsageFilter | None = None, bucket: str = "day",
                     bucket_value: str | None = None) -> DataFrame:
    """Per bucket: each model's cost and share of the bucket, plus counts.

    Drilling into a bucket filters on the bucket value itself and on its
    date, which prunes a stored table to one partition.  Without
    ``bucket_value`` every bucket is broken down at once; the share window
    is partitioned by bucket and runs on the small priced result.  Costs and
    counts roll up from one (bucket, model, session_id) aggregate.
    """
    fu = A.with_bucket(_filtered(u, f), bucket)
    if bucket_value is not None:
        day = F.try_to_date(F.lit(bucket_value[:10]))
        fu = fu.filter((F.col("bucket") == F.lit(bucket_value)) & (F.col("usage_date") == day))
    g = fu.groupBy("bucket", "model", "session_id").agg(*sum_tokens(), F.count(F.lit(1)).alias("messages"))
    bm = price_groups(g.groupBy("bucket", "model").agg(*_sums()), ["bucket"], as_sheet(rates))
    w = Window.partitionBy("bucket")
    total = F.coalesce(F.nullif(F.sum("cost_usd").over(w), F.lit(0.0)), F.lit(1.0))
    counts = g.groupBy("bucket").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.sum("messages").cast("bigint").alias("messages"),
        F.coalesce(F.sum(token_total()), F.lit(0)).cast("bigint").alias("tokens"),
    )
    rows = bm.select("bucket", "model", "cost_usd").withColumn("share_pct", F.col("cost_usd") / total * 100.0)
    return (
        rows.filter(F.col("cost_usd") > 0)
        .join(counts, "bucket")
        .orderBy(F.asc("bucket"), F.desc("cost_usd"), F.asc("model"))
    )


# R-12 ----------------------------------------------------------------------
def bucket_detail(u: DataFrame, rates, f: UsageFilter | None = None, bucket: str = "day") -> DataFrame:
    """Per bucket: token mix ratios and the bucket's share of the period."""
    ts = time_series(u, rates, f, bucket)
    tot = token_total()
    rows = ts.select(
        "bucket",
        "cost_usd",
        tot.alias("total_tokens"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("in_out_tokens"),
        S.cache_total().alias("cache_tokens"),
    )
    period = rows.agg(
        F.struct(
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("period_tokens"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("period_cost"),
        )
    ).scalar()
    out = rows.withColumn("period_tokens", period.getField("period_tokens")).withColumn(
        "period_cost", period.getField("period_cost")
    )
    return out.select(
        "bucket",
        "total_tokens",
        "in_out_tokens",
        S.share_pct(F.col("in_out_tokens"), F.col("total_tokens")).alias("in_out_pct"),
        "cache_tokens",
        S.share_pct(F.col("cache_tokens"), F.col("total_tokens")).alias("cache_pct"),
        "cost_usd",
        S.share_pct(F.col("total_tokens"), F.col("period_tokens")).alias("token_share_pct"),
        S.share_pct(F.col("cost_usd"), F.col("period_cost")).alias("cost_share_pct"),
    ).orderBy("bucket")


# R-13 ----------------------------------------------------------------------
def price_sheet(rates: DataFrame) -> DataFrame:
    """Rates most expensive first: output rate, then input rate, then model."""
    return rates.select(
        "model",
        *RATE_COLUMNS,
        F.coalesce("source", F.lit("manual")).alias("source"),
        "fetched_at",
        "updated_at",
    ).orderBy(F.desc("output_per_mtok_usd"), F.desc("input_per_mtok_usd"), F.asc("model"))


# R-15 ----------------------------------------------------------------------
def unpriced_models(u: DataFrame, rates, f: UsageFilter | None = None) -> DataFrame:
    """Models whose usage costs 0 because no candidate id has a rate."""
    pm = price_groups(fine(u, f, ["model"]), [], as_sheet(rates), with_cost=False)
    return pm.filter(F.col("matched_model").isNull()).select("model", *MEASURES).orderBy("model")


def model_rate_matches(u: DataFrame, rates) -> DataFrame:
    """Each distinct model with the sheet id that prices it (P-07/P-08)."""
    pm = price_groups(A.distinct_models(u), [], as_sheet(rates), with_cost=False)
    return pm.select("model", "matched_model", F.col("matched_model").isNotNull().alias("has_rate"), *RATE_COLUMNS)
