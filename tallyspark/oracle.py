"""DuckDB SQL twins of the registered queries (the correctness gate).

Each builder returns one SQL statement over the driver's pre-registered
views (lineitem, orders, customer, part, events, ...).  The usage views, the
fallback candidate list and the cost formula are written independently in
SQL here; only the test fixtures (rate sheet, budgets) and already-resolved
filter dates are shared with the Spark side.

Output conventions (mirrored by ``present`` in ``__spark_entry__``): integer
columns BIGINT, money and percentages DOUBLE rounded to 6 places,
timestamps as ``YYYY-MM-DD HH:MM:SS.ffffff`` text, lists as comma-joined
text.
"""

from __future__ import annotations

from .sources.fixtures import AS_OF, BUDGETS, EVENT_MODELS, RATE_SHEET, VIEW_MODEL_PREFIX
from .schemas import SYNTHETIC_MODEL

TOK = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
RATES = ["input_per_mtok_usd", "output_per_mtok_usd", "cache_write_per_mtok_usd", "cache_read_per_mtok_usd"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _num(x) -> str:
    return repr(float(x))


def r6(expr: str) -> str:
    """Round to 6 places via DECIMAL(38, 9): costs are exact 9-place decimals,
    so snapping to 9 places first removes float noise and makes ties exact."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN isinf({x}) OR isnan({x}) THEN {x} ELSE CAST(round(CAST({x} AS DECIMAL(38, 9)), 6) AS DOUBLE) END)"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


USAGE_LINEITEM = """
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS message_id,
       CAST(NULL AS VARCHAR) AS request_id,
       CAST(l.l_orderkey AS VARCHAR) AS session_id,
       '-seg-' || lower(c.c_mktsegment) AS project_slug,
       CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE '/seg/' || CAST(c.c_nationkey AS VARCHAR) END AS cwd,
       o.o_orderpriority AS git_branch,
       lower(p.p_type) || '-4-' || CAST(p.p_size % 5 AS VARCHAR) AS model,
       CAST(l.l_shipdate AS TIMESTAMP) AS ts,
       CAST(floor(l.l_quantity) AS BIGINT) AS input_tokens,
       CAST(floor(l.l_extendedprice) AS BIGINT) AS output_tokens,
       CAST(l.l_partkey % 1000 AS BIGINT) AS cache_creation_tokens,
       CAST(l.l_suppkey AS BIGINT) AS cache_read_tokens,
       'lineitem' AS source_file,
       CAST(l.l_linenumber AS BIGINT) AS source_line
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn
      FROM lineitem) l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.rn = 1
"""


def _event_model_sql() -> str:
    whens = " ".join(f"WHEN event_type = {q(et)} THEN {q(m)}" for et, m in EVENT_MODELS.items())
    return (
        f"CASE WHEN event_type = 'view' THEN {q(VIEW_MODEL_PREFIX)} || CAST(6 + user_id % 2 AS VARCHAR) "
        f"{whens} ELSE 'm-' || event_type END"
    )


USAGE_EVENTS = f"""
SELECT CAST(event_id AS VARCHAR) AS message_id,
       CAST(NULL AS VARCHAR) AS request_id,
       CAST(user_id AS VARCHAR) AS session_id,
       '-u-' || CAST(user_id % 7 AS VARCHAR) AS project_slug,
       CASE WHEN user_id % 3 = 0 THEN '' ELSE '/u/' || CAST(user_id % 7 AS VARCHAR) || '/' || CAST(user_id % 2 AS VARCHAR) END AS cwd,
       CASE WHEN event_type = 'view' THEN 'HEAD' ELSE event_type END AS git_branch,
       {_event_model_sql()} AS model,
       CAST(ts AS TIMESTAMP) AS ts,
       COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens,
       COALESCE(CAST(floor(value) AS BIGINT), 0) AS output_tokens,
       CAST(event_id % 1000 AS BIGINT) AS cache_creation_tokens,
       CAST(event_id % 7919 AS BIGINT) AS cache_read_tokens,
       'events' AS source_file,
       CAST(event_id AS BIGINT) AS source_line
FROM events
"""

VIEWS = {"lineitem": USAGE_LINEITEM, "events": USAGE_EVENTS}


def usage_cte(view: str) -> str:
    return (
        f"u0 AS ({VIEWS[view]}),\n"
        "u AS (SELECT *, COALESCE(NULLIF(cwd, ''), project_slug) AS project_key, CAST(ts AS DATE) AS usage_date FROM u0)"
    )


def rates_cte(name: str = "rates", without: str | None = None) -> str:
    rows = ",\n  ".join(
        f"({q(m)}, {_num(i)}, {_num(o)}, {_num(w)}, {_num(r)}, {q(s)})"
        for (m, i, o, w, r, s) in RATE_SHEET
        if without is None or not m.startswith(without)
    )
    return f"{name}(model, {', '.join(RATES)}, source) AS (VALUES\n  {rows})"


def budgets_cte() -> str:
    def b(v):
        return "NULL" if v is None else ("TRUE" if v else "FALSE")

    rows = ",\n  ".join(f"({i}, {q(n)}, {_num(a)}, {b(s)})" for (i, n, a, s) in BUDGETS)
    return f"budgets(id, name, amount_usd, show_in_dashboard) AS (VALUES\n  {rows})"


def rate_match_cte(src: str, name: str) -> str:
    """CTEs ending in ``{name}``: (model, matched_model, 4 rates) per distinct model of ``src``."""
    return f"""
{name}_c AS (SELECT model, regexp_replace(model, '-[0-9]{{8}}$', '') AS ds FROM (SELECT DISTINCT model FROM {src})),
{name}_t AS (
  SELECT model, ds, string_split(ds, '-') AS segs, len(string_split(ds, '-')) AS n,
         COALESCE(list_position(list_transform(list_reverse(string_split(ds, '-')),
                                               lambda x: regexp_full_match(x, '[0-9]+')), false), 0) AS p
  FROM {name}_c),
{name}_l AS (
  SELECT model,
         list_concat([model],
                     CASE WHEN ds <> model THEN [ds] ELSE []::VARCHAR[] END,
                     CASE WHEN least(CASE WHEN p = 0 THEN n ELSE p - 1 END, n - 2) >= 1
                          THEN list_transform(range(1, least(CASE WHEN p = 0 THEN n ELSE p - 1 END, n - 2) + 1),
                                              lambda k: array_to_string(segs[1:n - k], '-'))
                          ELSE []::VARCHAR[] END) AS cands
  FROM {name}_t),
{name}_e AS (SELECT model, unnest(cands) AS cand, unnest(range(1, len(cands) + 1)) AS pos FROM {name}_l),
{name} AS (
  SELECT model, matched_model, {', '.join(RATES)} FROM (
    SELECT e.model, r.model AS matched_model, {', '.join('r.' + c for c in RATES)},
           row_number() OVER (PARTITION BY e.model ORDER BY e.pos) AS rn
    FROM {name}_e e JOIN rates r ON r.model = e.cand) WHERE rn = 1)"""


def cost_sql(rate_alias: str = "", tok_alias: str | None = None) -> str:
    """tokens x rate / 1e6 summed over the four categories; 0 without a rate."""
    b = rate_alias + "." if rate_alias else ""
    if tok_alias is None:
        tok_alias = "a" if rate_alias else ""
    a = tok_alias + "." if tok_alias else ""
    terms = " + ".join(f"CAST({a}{t} AS DOUBLE) * {b}{r} / 1000000.0" for t, r in zip(TOK, RATES))
    return f"COALESCE({terms}, 0.0)"


def sums(prefix: str = "") -> str:
    return ", ".join(f"CAST(COALESCE(SUM({prefix}{t}), 0) AS BIGINT) AS {t}" for t in TOK)


def where(from_day: str | None = None, to_day: str | None = None, extra: str | None = None) -> str:
    preds = [f"model <> {q(SYNTHETIC_MODEL)}"]
    if from_day:
        preds.append(f"usage_date >= DATE {q(from_day)}")
    if to_day:
        preds.append(f"usage_date < DATE {q(to_day)}")
    if extra:
        preds.append(extra)
    return " AND ".join(preds)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def priced_models_ctes(view: str, flt: str, name: str = "pm", without: str | None = None) -> list[str]:
    return [
        usage_cte(view),
        rates_cte(without=without),
        f"f AS (SELECT * FROM u WHERE {flt})",
        f"{name}0 AS (SELECT model, {sums()}, COUNT(*) AS messages FROM f GROUP BY model)",
        rate_match_cte(f"{name}0", f"{name}_r"),
        f"{name} AS (SELECT a.*, b.matched_model, {', '.join('b.' + c for c in RATES)} FROM {name}0 a LEFT JOIN {name}_r b ON a.model = b.model)",
    ]


# --- reports ----------------------------------------------------------------


def model_ranking(view: str, flt: str | None = None) -> str:
    return with_(*priced_models_ctes(view, flt or where())) + (
        f"SELECT model, {', '.join(TOK)}, messages, {r6(cost_sql())} AS cost_usd FROM pm"
    )


def summary(view: str, flt: str | None = None) -> str:
    ctes = priced_models_ctes(view, flt or where()) + [
        f"s AS (SELECT {sums()}, COUNT(DISTINCT session_id) AS sessions, COUNT(*) AS messages FROM f)",
        f"c AS (SELECT COALESCE(SUM({cost_sql()}), 0.0) AS cost_usd FROM pm)",
    ]
    return with_(*ctes) + f"SELECT s.*, {r6('c.cost_usd')} AS cost_usd FROM s CROSS JOIN c"


def bucket_sql(bucket: str) -> str:
    return "strftime(ts, '%Y-%m-%d %H:00:00')" if bucket == "hour" else "strftime(ts, '%Y-%m-%d')"


def _bucket_model_ctes(view: str, flt: str, bucket: str) -> list[str]:
    return [
        usage_cte(view),
        rates_cte(),
        f"f AS (SELECT *, {bucket_sql(bucket)} AS bucket FROM u WHERE {flt})",
        f"bm0 AS (SELECT bucket, model, {sums()} FROM f WHERE bucket IS NOT NULL GROUP BY bucket, model)",
        rate_match_cte("bm0", "bm_r"),
        f"bm AS (SELECT a.*, {cost_sql('b')} AS cost FROM bm0 a LEFT JOIN bm_r b ON a.model = b.model)",
    ]


def time_series(view: str, bucket: str, flt: str | None = None) -> str:
    ctes = _bucket_model_ctes(view, flt or where(), bucket)
    return with_(*ctes) + (
        f"SELECT bucket, {sums()}, {r6('SUM(cost)')} AS cost_usd FROM bm GROUP BY bucket"
    )


def time_series_models(view: str, bucket: str, flt: str | None = None) -> str:
    ctes = _bucket_model_ctes(view, flt or where(), bucket)
    return with_(*ctes) + f"SELECT bucket, model, {', '.join(TOK)}, {r6('cost')} AS cost_usd FROM bm"


def session_page(view: str, limit: int, offset: int, flt: str | None = None) -> str:
    ctes = [
        usage_cte(view),
        rates_cte(),
        f"f AS (SELECT * FROM u WHERE {flt or where()})",
        f"""sr AS (SELECT session_id, project_slug, COALESCE(MAX(cwd), '') AS cwd, COALESCE(MAX(git_branch), '') AS git_branch,
                  array_to_string(list_sort(list_distinct(list(model))), ',') AS models,
                  MIN(ts) AS first_seen, MAX(ts) AS last_seen, {sums()}, COUNT(*) AS messages
           FROM f GROUP BY session_id, project_slug)""",
        f"page AS (SELECT * FROM sr ORDER BY last_seen DESC, session_id, project_slug LIMIT {limit} OFFSET {offset})",
        f"bd0 AS (SELECT session_id, project_slug, model, {sums()} FROM f WHERE session_id IN (SELECT session_id FROM page) GROUP BY session_id, project_slug, model)",
        rate_match_cte("bd0", "bd_r"),
        f"sc AS (SELECT a.session_id, SUM({cost_sql('b')}) AS cost_usd FROM bd0 a LEFT JOIN bd_r b ON a.model = b.model GROUP BY a.session_id)",
        "tot AS (SELECT COUNT(*) AS total FROM (SELECT 1 FROM f GROUP BY session_id, project_slug))",
    ]
    return with_(*ctes) + (
        f"SELECT page.session_id, page.project_slug, page.cwd, page.git_branch, page.models, "
        f"{ts_text('page.first_seen')} AS first_seen, {ts_text('page.last_seen')} AS last_seen, "
        f"{', '.join('page.' + t for t in TOK)}, page.messages, {r6('COALESCE(sc.cost_usd, 0.0)')} AS cost_usd, "
        "page.git_branch NOT IN ('', 'HEAD') AS has_branch, page.cache_read_tokens + page.cache_creation_tokens AS cache_total, "
        f"tot.total, CAST({limit} AS BIGINT) AS page_limit, CAST({offset} AS BIGINT) AS page_offset "
        "FROM page LEFT JOIN sc ON page.session_id = sc.session_id CROSS JOIN tot"
    )


def session_records(view: str, session: str | None = None) -> str:
    flt = where(extra=None if session is None else f"session_id = {session}")
    ctes = [
        usage_cte(view),
        rates_cte(),
        f"f AS (SELECT * FROM u WHERE {flt})",
        rate_match_cte("f", "f_r"),
    ]
    return with_(*ctes) + (
        f"SELECT a.message_id, a.session_id, {ts_text('a.ts')} AS ts, a.model, COALESCE(a.git_branch, '') AS git_branch, "
        f"{', '.join('a.' + t for t in TOK)}, a.source_file, a.source_line, {r6(cost_sql('b'))} AS cost_usd, "
        "COALESCE(a.git_branch, '') NOT IN ('', 'HEAD') AS has_branch, a.cache_read_tokens + a.cache_creation_tokens AS cache_total "
        "FROM f a LEFT JOIN f_r b ON a.model = b.model"
    )


def filter_projects(view: str) -> str:
    return with_(usage_cte(view)) + "SELECT DISTINCT project_key FROM u"


def filter_models(view: str) -> str:
    return with_(usage_cte(view)) + f"SELECT DISTINCT model FROM u WHERE model <> {q(SYNTHETIC_MODEL)}"


def _project_ctes(view: str, flt: str) -> list[str]:
    return [
        usage_cte(view),
        rates_cte(),
        f"f AS (SELECT * FROM u WHERE {flt})",
        f"pmt AS (SELECT project_key, model, {sums()}, COUNT(*) AS messages FROM f GROUP BY project_key, model)",
        rate_match_cte("pmt", "pmt_r"),
        f"""pr AS (SELECT a.project_key, array_to_string(list_sort(list_distinct(list(a.model))), ',') AS models,
                  {sums('a.')}, CAST(SUM(a.messages) AS BIGINT) AS messages, SUM({cost_sql('b')}) AS cost_usd
           FROM pmt a LEFT JOIN pmt_r b ON a.model = b.model GROUP BY a.project_key)""",
        "sp AS (SELECT project_key, COUNT(DISTINCT session_id) AS sessions FROM f GROUP BY project_key)",
        "prj AS (SELECT pr.*, COALESCE(sp.sessions, 0) AS sessions FROM pr LEFT JOIN sp ON pr.project_key = sp.project_key)",
    ]


def project_ranking(view: str, flt: str | None = None) -> str:
    return with_(*_project_ctes(view, flt or where())) + (
        f"SELECT project_key, models, {', '.join(TOK)}, messages, sessions, {r6('cost_usd')} AS cost_usd FROM prj"
    )


def budget_report(view: str, month_start: str) -> str:
    ctes = priced_models_ctes(view, where(from_day=month_start)) + [
        budgets_cte(),
        f"ms AS (SELECT COALESCE(SUM({cost_sql()}), 0.0) AS spent_usd FROM pm)",
        """br AS (SELECT CAST(b.id AS BIGINT) AS id, b.name, CAST(b.amount_usd AS DOUBLE) AS amount_usd,
                  COALESCE(b.show_in_dashboard, FALSE) AS show_in_dashboard, ms.spent_usd,
                  CASE WHEN b.amount_usd > 0 THEN ms.spent_usd / b.amount_usd * 100.0 ELSE 0.0 END AS pct_used
           FROM budgets b CROSS JOIN ms)""",
    ]
    return with_(*ctes) + (
        f"SELECT id, name, {r6('amount_usd')} AS amount_usd, show_in_dashboard, {r6('spent_usd')} AS spent_usd, "
        f"{r6('pct_used')} AS pct_used, "
        "CASE WHEN pct_used >= 100.0 THEN 'over' WHEN pct_used >= 80.0 THEN 'warn' ELSE 'ok' END AS status, "
        f"{r6('least(100.0, pct_used)')} AS bar_pct FROM br"
    )


COMPARED = ["cost_usd", "sessions", "messages"] + TOK


def period_comparison(view: str, cur: tuple[str | None, str | None], prev: tuple[str, str], label: str) -> str:
    def side(name, bounds):
        return [
            f"{name}_f AS (SELECT * FROM u WHERE {where(*bounds)})",
            f"{name}_pm0 AS (SELECT model, {sums()} FROM {name}_f GROUP BY model)",
            rate_match_cte(f"{name}_pm0", f"{name}_r"),
            f"""{name} AS (SELECT (SELECT COALESCE(SUM({cost_sql('b')}), 0.0) FROM {name}_pm0 a LEFT JOIN {name}_r b ON a.model = b.model) AS cost_usd,
                       (SELECT COUNT(DISTINCT session_id) FROM {name}_f) AS sessions,
                       (SELECT COUNT(*) FROM {name}_f) AS messages,
                       {', '.join(f'(SELECT COALESCE(SUM({t}), 0) FROM {name}_f) AS {t}' for t in TOK)})""",
        ]

    ctes = [usage_cte(view), rates_cte()] + side("cur", cur) + side("prev", prev)
    unions = " UNION ALL ".join(
        f"SELECT {q(m)} AS metric, CAST(cur.{m} AS DOUBLE) AS current, CAST(prev.{m} AS DOUBLE) AS previous FROM cur CROSS JOIN prev"
        for m in COMPARED
    )
    ctes.append(f"mx AS ({unions})")
    ctes.append(
        "pc AS (SELECT *, CASE WHEN previous IS NULL OR previous = 0 THEN CASE WHEN current > 0 THEN 'inf'::DOUBLE ELSE 0.0 END "
        "ELSE (current - previous) / previous * 100.0 END AS pct_change FROM mx)"
    )
    return with_(*ctes) + (
        f"SELECT metric, {r6('current')} AS current, {r6('previous')} AS previous, {r6('pct_change')} AS pct_change, "
        "CASE WHEN pct_change IS NULL THEN NULL WHEN pct_change = 'inf'::DOUBLE THEN 'new' WHEN pct_change > 0 THEN 'up' "
        "WHEN pct_change < 0 THEN 'down' ELSE 'flat' END AS direction, "
        f"{q(label)} AS label FROM pc"
    )


def slug_path_sql(expr: str) -> str:
    return (
        f"CASE WHEN {expr} IS NULL THEN '' WHEN starts_with({expr}, '-') "
        f"THEN '/' || replace(substr({expr}, 2), '-', '/') ELSE {expr} END"
    )


def metric_breakdown(view: str, metric: str, flt: str | None = None) -> str:
    flt = flt or where()
    if metric in ("sessions", "messages"):
        ctes = _project_ctes(view, flt)
        src = f"SELECT {slug_path_sql('project_key')} AS label, CAST({metric} AS DOUBLE) AS value FROM prj"
    else:
        ctes = priced_models_ctes(view, flt)
        val = cost_sql() if metric == "cost_usd" else metric
        src = f"SELECT model AS label, CAST({val} AS DOUBLE) AS value FROM pm"
    card = {
        "cost_usd": f"(SELECT COALESCE(SUM({cost_sql('b')}), 0.0) FROM (SELECT model, {sums()} FROM f GROUP BY model) a LEFT JOIN pm_card_r b ON a.model = b.model)",
        "sessions": "(SELECT COUNT(DISTINCT session_id) FROM f)",
        "messages": "(SELECT COUNT(*) FROM f)",
    }.get(metric, f"(SELECT COALESCE(SUM({metric}), 0) FROM f)")
    ctes = ctes + [
        rate_match_cte("f", "pm_card_r"),
        f"src AS ({src})",
        f"tot AS (SELECT COALESCE(NULLIF(CAST({card} AS DOUBLE), 0.0), NULLIF((SELECT COALESCE(SUM(value), 0.0) FROM src), 0.0), 1.0) AS total)",
        "top AS (SELECT * FROM src WHERE value > 0 ORDER BY value DESC, label LIMIT 15)",
    ]
    return with_(*ctes) + (
        f"SELECT label, {r6('value')} AS value, {r6('value / tot.total * 100.0')} AS share_pct, "
        "CAST(row_number() OVER (ORDER BY value DESC, label) AS BIGINT) AS rank FROM top CROSS JOIN tot"
    )


def bucket_breakdown(view: str, bucket: str, flt: str | None = None) -> str:
    ctes = _bucket_model_ctes(view, flt or where(), bucket) + [
        f"""cnt AS (SELECT bucket, COUNT(DISTINCT session_id) AS sessions, COUNT(*) AS messages,
                   CAST(COALESCE(SUM({' + '.join(TOK)}), 0) AS BIGINT) AS tokens FROM f WHERE bucket IS NOT NULL GROUP BY bucket)""",
        "sh AS (SELECT bucket, model, cost, cost / COALESCE(NULLIF(SUM(cost) OVER (PARTITION BY bucket), 0.0), 1.0) * 100.0 AS share_pct FROM bm)",
    ]
    return with_(*ctes) + (
        f"SELECT sh.bucket, sh.model, {r6('sh.cost')} AS cost_usd, {r6('sh.share_pct')} AS share_pct, "
        "cnt.sessions, cnt.messages, cnt.tokens FROM sh JOIN cnt ON sh.bucket = cnt.bucket WHERE sh.cost > 0"
    )


def bucket_detail(view: str, bucket: str, flt: str | None = None) -> str:
    ctes = _bucket_model_ctes(view, flt or where(), bucket) + [
        f"ts AS (SELECT bucket, {sums()}, SUM(cost) AS cost_usd FROM bm GROUP BY bucket)",
        f"""rw AS (SELECT bucket, cost_usd, {' + '.join(TOK)} AS total_tokens, input_tokens + output_tokens AS in_out_tokens,
                  cache_read_tokens + cache_creation_tokens AS cache_tokens FROM ts)""",
        "pd AS (SELECT COALESCE(SUM(total_tokens), 0) AS period_tokens, COALESCE(SUM(cost_usd), 0.0) AS period_cost FROM rw)",
    ]

    def share(v, t):
        return r6(f"CASE WHEN {t} <> 0 THEN CAST({v} AS DOUBLE) / {t} * 100.0 ELSE 0.0 END")

    return with_(*ctes) + (
        "SELECT bucket, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(in_out_tokens AS BIGINT) AS in_out_tokens, "
        f"{share('in_out_tokens', 'total_tokens')} AS in_out_pct, CAST(cache_tokens AS BIGINT) AS cache_tokens, "
        f"{share('cache_tokens', 'total_tokens')} AS cache_pct, {r6('cost_usd')} AS cost_usd, "
        f"{share('total_tokens', 'period_tokens')} AS token_share_pct, {share('cost_usd', 'period_cost')} AS cost_share_pct "
        "FROM rw CROSS JOIN pd"
    )


def unpriced_models(view: str, without: str | None = None) -> str:
    return with_(*priced_models_ctes(view, where(), without=without)) + (
        f"SELECT model, {', '.join(TOK)}, messages FROM pm WHERE matched_model IS NULL"
    )


def model_rate_matches(view: str) -> str:
    ctes = [usage_cte(view), rates_cte(), f"dm AS (SELECT DISTINCT model FROM u WHERE model <> {q(SYNTHETIC_MODEL)})",
            rate_match_cte("dm", "dm_r")]
    return with_(*ctes) + (
        "SELECT dm.model, dm_r.matched_model, dm_r.matched_model IS NOT NULL AS has_rate, "
        f"{', '.join(r6('dm_r.' + c) + ' AS ' + c for c in RATES)} FROM dm LEFT JOIN dm_r ON dm.model = dm_r.model"
    )


def search_filter_sql(search: str) -> str:
    """The free-text predicate: ASCII-folded LIKE, the user's % and _ kept, no escape."""
    needle = "%" + search + "%"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    n = q(needle.translate(str.maketrans(up, low)))
    fields = ["project_slug", "COALESCE(cwd, '')", "COALESCE(git_branch, '')", "model", "session_id"]
    return "(" + " OR ".join(f"translate({x}, '{up}', '{low}') LIKE {n}" for x in fields) + ")"


def as_of(view: str) -> str:
    return AS_OF[view]


def ingested_event_logs() -> str:
    """Fact rows the ingest of the event-derived logs must store."""
    from .sources.fixtures import LOG_PARTITION

    return f"""
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id,
         CASE WHEN event_id % 2 = 1 THEN 'req-' || CAST(event_id AS VARCHAR) END AS request_id,
         CAST(user_id AS VARCHAR) AS session_id,
         '{LOG_PARTITION}=-u-' || CAST(user_id % 7 AS VARCHAR) AS project_slug,
         CASE WHEN user_id % 3 = 0 THEN NULL ELSE '/u/' || CAST(user_id % 7 AS VARCHAR) || '/' || CAST(user_id % 2 AS VARCHAR) END AS cwd,
         CASE WHEN event_type = 'view' THEN 'HEAD' ELSE event_type END AS git_branch,
         {_event_model_sql()} AS model,
         CAST(ts AS TIMESTAMP) AS ts,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens,
         COALESCE(CAST(floor(value) AS BIGINT), 0) AS output_tokens,
         CAST(event_id % 1000 AS BIGINT) AS cache_creation_tokens,
         CAST(event_id % 7919 AS BIGINT) AS cache_read_tokens
  FROM events WHERE event_type <> 'signup')
SELECT message_id, request_id, session_id, project_slug, cwd, git_branch, model, {ts_text('ts')} AS ts,
       {', '.join(TOK)}, COALESCE(NULLIF(cwd, ''), project_slug) AS project_key,
       strftime(CAST(ts AS DATE), '%Y-%m-%d') AS usage_date
FROM r"""


# --- price feed and sync ------------------------------------------------------


def _per_million_sql(x: str) -> str:
    num = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0 "
        f"WHEN regexp_full_match({x}, '{num}') THEN "
        f"CASE WHEN isinf(TRY_CAST({x} AS DOUBLE)) THEN 0.0 ELSE COALESCE(TRY_CAST({x} AS DOUBLE) * 1000000.0, 0.0) END "
        f"WHEN lower({x}) IN ('inf', '+inf', 'infinity', '+infinity') THEN 'inf'::DOUBLE "
        f"WHEN lower({x}) IN ('-inf', '-infinity') THEN '-inf'::DOUBLE "
        f"WHEN lower({x}) IN ('nan', '+nan', '-nan') THEN 'nan'::DOUBLE ELSE 0.0 END)"
    )


def feed_ctes(sync_at: str) -> list[str]:
    from .functions.feed import VENDOR_PREFIX
    from .sources.fixtures import OTHER_VENDOR, VARIANT_SUFFIX

    n = len(VENDOR_PREFIX)
    return [
        "g AS (SELECT p_type, p_size, COUNT(*) AS n, MIN(p_partkey) AS lo, MAX(p_partkey) AS hi FROM part GROUP BY p_type, p_size)",
        f"""feed AS (SELECT CAST(p_size AS BIGINT) AS pos,
                 (CASE WHEN p_size % 10 = 9 THEN {q(OTHER_VENDOR)} ELSE {q(VENDOR_PREFIX)} END) || lower(p_type) || '-4.'
                   || CAST(p_size % 5 AS VARCHAR) || (CASE WHEN p_size % 10 = 7 THEN {q(VARIANT_SUFFIX)} ELSE '' END) AS id,
                 CASE WHEN p_size % 13 = 0 THEN '' WHEN p_size % 17 = 0 THEN 'n/a' ELSE CAST(lo % 20 AS VARCHAR) || 'e-7' END AS prompt,
                 CASE WHEN p_size % 11 = 0 THEN '0' ELSE CAST(n % 50 + 1 AS VARCHAR) || 'e-7' END AS completion,
                 CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(hi % 7 AS VARCHAR) || 'e-8' END AS input_cache_read,
                 CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(hi % 9 + 1 AS VARCHAR) || 'e-7' END AS input_cache_write
          FROM g)""",
        f"""nf0 AS (SELECT pos, replace(substr(id, {n + 1}), '.', '-') AS model,
                 {_per_million_sql('prompt')} AS i, {_per_million_sql('completion')} AS o,
                 {_per_million_sql('input_cache_write')} AS w, {_per_million_sql('input_cache_read')} AS r
          FROM feed WHERE starts_with(id, {q(VENDOR_PREFIX)}) AND NOT contains(substr(id, {n + 1}), ':'))""",
        """nf1 AS (SELECT pos, model, i AS input_per_mtok_usd, o AS output_per_mtok_usd,
                 CASE WHEN w = 0 THEN i * 1.25 ELSE w END AS cache_write_per_mtok_usd,
                 CASE WHEN r = 0 THEN i * 0.1 ELSE r END AS cache_read_per_mtok_usd
          FROM nf0 WHERE NOT (i = 0 AND o = 0))""",
        f"""nf AS (SELECT model, {', '.join(RATES)}, 'openrouter' AS source,
                 TIMESTAMP {q(sync_at)} AS fetched_at, TIMESTAMP {q(sync_at)} AS updated_at
          FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pos DESC) AS rn FROM nf1) WHERE rn = 1)""",
    ]


def sheet_ctes(sync_at: str) -> list[str]:
    from .plans.pricing_sync import DEFAULT_RATES

    seeds = ",\n  ".join(
        f"({q(m)}, {_num(i)}, {_num(o)}, {_num(w)}, {_num(r)})" for (m, i, o, w, r) in DEFAULT_RATES
    )
    return [
        rates_cte("rates0"),
        f"seeds(model, {', '.join(RATES)}) AS (VALUES\n  {seeds})",
        f"""sheet AS (SELECT model, {', '.join(RATES)}, source, CAST(NULL AS TIMESTAMP) AS fetched_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM rates0
            UNION ALL
            SELECT model, {', '.join(RATES)}, 'seed', CAST(NULL AS TIMESTAMP), TIMESTAMP {q(sync_at)} FROM seeds
            WHERE model NOT IN (SELECT model FROM rates0))""",
    ] + feed_ctes(sync_at) + [
        """acts AS (SELECT nf.*, CASE WHEN s.model IS NULL THEN 'inserted'
                                   WHEN COALESCE(s.source, 'manual') = 'manual' THEN 'skipped_manual'
                                   ELSE 'updated' END AS action
          FROM nf LEFT JOIN sheet s ON nf.model = s.model)""",
        f"""rates AS (SELECT * FROM sheet WHERE model NOT IN (SELECT model FROM acts WHERE action <> 'skipped_manual')
            UNION ALL
            SELECT model, {', '.join(RATES)}, source, fetched_at, updated_at FROM acts WHERE action <> 'skipped_manual')""",
    ]


def _sheet_select(src: str, source: str | None = None) -> str:
    src_col = f"{q(source)} AS source" if source else "source"
    return (
        f"SELECT model, {', '.join(r6(c) + ' AS ' + c for c in RATES)}, {src_col}, "
        f"{ts_text('fetched_at')} AS fetched_at, {ts_text('updated_at')} AS updated_at FROM {src}"
    )


def normalized_feed(sync_at: str) -> str:
    return with_(*feed_ctes(sync_at)) + _sheet_select("nf")


def synced_sheet(sync_at: str, source: str | None = None) -> str:
    return with_(*sheet_ctes(sync_at)) + _sheet_select("rates", source)


def sync_counters(sync_at: str) -> str:
    return with_(*sheet_ctes(sync_at)) + (
        "SELECT COUNT(*) FILTER (WHERE action = 'inserted') AS inserted, "
        "COUNT(*) FILTER (WHERE action = 'updated') AS updated, "
        "COUNT(*) FILTER (WHERE action = 'skipped_manual') AS skipped_manual, "
        f"{ts_text('MAX(fetched_at)')} AS fetched_at FROM acts"
    )


def model_ranking_synced(view: str, sync_at: str) -> str:
    ctes = [usage_cte(view)] + sheet_ctes(sync_at) + [
        f"f AS (SELECT * FROM u WHERE {where()})",
        f"pm0 AS (SELECT model, {sums()}, COUNT(*) AS messages FROM f GROUP BY model)",
        rate_match_cte("pm0", "pm_r"),
        f"pm AS (SELECT a.*, {', '.join('b.' + c for c in RATES)} FROM pm0 a LEFT JOIN pm_r b ON a.model = b.model)",
    ]
    return with_(*ctes) + f"SELECT model, {', '.join(TOK)}, messages, {r6(cost_sql())} AS cost_usd FROM pm"


def budget_change_set(view: str, month_start: str) -> str:
    """Budgets created from nation rows, some updated and deleted, pinned report."""
    ctes = priced_models_ctes(view, where(from_day=month_start)) + [
        f"ms AS (SELECT COALESCE(SUM({cost_sql()}), 0.0) AS spent_usd FROM pm)",
        """cr AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey, lower(n_name), n_nationkey * 25.0) AS BIGINT) AS id,
                  lower(n_name) AS name, CAST(n_nationkey * 25.0 AS DOUBLE) AS amount_usd
           FROM nation WHERE lower(n_name) IS NOT NULL AND lower(n_name) <> '' AND n_nationkey * 25.0 > 0)""",
        """up AS (SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS name, CAST(n_nationkey * 50.0 AS DOUBLE) AS amount_usd
           FROM nation WHERE n_regionkey = 1 AND lower(n_name) <> '' AND n_nationkey * 50.0 > 0)""",
        """b2 AS (SELECT cr.id, COALESCE(up.name, cr.name) AS name, COALESCE(up.amount_usd, cr.amount_usd) AS amount_usd,
                  up.id IS NOT NULL AS show_in_dashboard FROM cr LEFT JOIN up ON cr.id = up.id)""",
        "b3 AS (SELECT * FROM b2 WHERE id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 0) AND show_in_dashboard)",
        """br AS (SELECT b.id, b.name, b.amount_usd, b.show_in_dashboard, ms.spent_usd,
                  CASE WHEN b.amount_usd > 0 THEN ms.spent_usd / b.amount_usd * 100.0 ELSE 0.0 END AS pct_used
           FROM b3 b CROSS JOIN ms)""",
    ]
    return with_(*ctes) + (
        f"SELECT id, name, {r6('amount_usd')} AS amount_usd, show_in_dashboard, {r6('spent_usd')} AS spent_usd, "
        f"{r6('pct_used')} AS pct_used, "
        "CASE WHEN pct_used >= 100.0 THEN 'over' WHEN pct_used >= 80.0 THEN 'warn' ELSE 'ok' END AS status, "
        f"{r6('least(100.0, pct_used)')} AS bar_pct FROM br"
    )


def top_models(view: str, k: int = 15) -> str:
    return with_(*priced_models_ctes(view, where())) + (
        f"SELECT model, {', '.join(TOK)}, messages, {r6(cost_sql())} AS cost_usd, "
        f"CAST(row_number() OVER (ORDER BY {cost_sql()} DESC, model) AS BIGINT) AS rank "
        f"FROM pm ORDER BY {cost_sql()} DESC, model LIMIT {k}"
    )


def top_projects(view: str, k: int = 15) -> str:
    return with_(*_project_ctes(view, where())) + (
        f"SELECT project_key, models, {', '.join(TOK)}, messages, sessions, {r6('cost_usd')} AS cost_usd, "
        "CAST(row_number() OVER (ORDER BY cost_usd DESC, project_key) AS BIGINT) AS rank "
        f"FROM prj ORDER BY cost_usd DESC, project_key LIMIT {k}"
    )


# --- ingest, edits and stored tables -------------------------------------------


def live_totals(where: str = "true") -> str:
    return (
        f"SELECT substr(ts, 1, 13) || ':00:00' AS bucket, model, {', '.join(f'CAST(SUM({t}) AS BIGINT) AS {t}' for t in TOK)}, "
        f"COUNT(*) AS messages FROM ({ingested_event_logs()}) WHERE {where} GROUP BY 1, 2"
    )


def odd_names() -> str:
    """The folder names as the writer escapes them: "[", "]", "{" and "%" become "%" and two hex digits."""
    return (
        "SELECT message_id, project_slug || ' a+b %5B1%5D%7Bx}%2541' AS project_slug "
        f"FROM ({ingested_event_logs()})"
    )


def numbered_lines() -> str:
    return (
        "SELECT CAST(event_id AS VARCHAR) AS message_id, "
        "row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS source_line FROM events"
    )


def quarantined() -> str:
    return (
        "SELECT 'malformed_json' AS reason, '{\"type\":\"assistant\",\"message\":{\"id\":' || CAST(event_id AS VARCHAR) AS line "
        "FROM events WHERE event_id % 50 = 0"
    )


def manifest_lines() -> str:
    """Lines of each log folder: one an event, two more every 50th event, replays in their own folder."""
    return """
SELECT slug, CAST(SUM(n) AS BIGINT) AS lines FROM (
  SELECT 'p=-u-' || CAST(user_id % 7 AS VARCHAR) AS slug, 1 + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS n FROM events
  UNION ALL SELECT 'p=~replay', 1 FROM events WHERE event_id % 10 = 0 AND event_type <> 'signup') GROUP BY slug"""


def rate_change_set() -> str:
    """Rates created from parts, a fifth of them edited twice (the last stays), a fifth deleted; with each edit's status."""
    return f"""
WITH n AS (SELECT 'n-' || CAST(p_partkey AS VARCHAR) AS model, p_partkey AS k, p_partkey % 5 AS r FROM part)
SELECT 'sheet' AS kind, model, CAST(CASE WHEN r = 2 THEN k * 3 ELSE k END AS DOUBLE) AS input_per_mtok_usd, 'manual' AS state
FROM n WHERE r <> 4
UNION ALL SELECT 'create', model, NULL, 'created' FROM n
UNION ALL SELECT 'create', model, NULL, 'conflict' FROM n WHERE r = 1
UNION ALL SELECT 'update', model, NULL, 'updated' FROM n, (VALUES (2), (3)) f(x) WHERE r = 2
UNION ALL SELECT 'update', 'no-' || model, NULL, 'not_found' FROM n WHERE r = 3
UNION ALL SELECT 'upsert', model, CAST(k * 5 AS DOUBLE), 'manual' FROM n WHERE r = 0"""


def stored_budgets() -> str:
    return (
        "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_custkey * 2.5 AS DOUBLE) AS amount_usd, "
        "FALSE AS show_in_dashboard, '2024-01-02 03:04:05.123456' AS created_at, CAST(NULL AS VARCHAR) AS updated_at FROM customer"
    )


def stored_times() -> str:
    text = ts_text("t")
    return f"""
SELECT model, CASE WHEN t IS NULL THEN NULL ELSE {text} END AS updated_at FROM (
  SELECT CAST(event_id AS VARCHAR) AS model,
         CASE event_id % 6 WHEN 2 THEN CAST(ts AS TIMESTAMP) - INTERVAL 2 HOUR
                           WHEN 4 THEN date_trunc('second', CAST(ts AS TIMESTAMP))
                           WHEN 5 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS t FROM events)"""
