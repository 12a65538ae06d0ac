"""Explicit schemas.  Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Values the data model defines; they must stay exactly as written.
SYNTHETIC_MODEL = "<synthetic>"          # placeholder model id excluded from filtered reports
ASSISTANT_TYPE = "assistant"             # log line type that carries usage
SOURCE_MANUAL = "manual"                 # price row edited by a user; never touched by a sync
SOURCE_SEED = "seed"                     # price row from the built-in defaults
SOURCE_FEED = "openrouter"               # price row written by a provider sync
ZERO_TIME = "0001-01-01 00:00:00"        # decode value of a missing timestamp
# ---------------------------------------------------------------------------

TOKEN_COLUMNS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
RATE_COLUMNS = [
    "input_per_mtok_usd",
    "output_per_mtok_usd",
    "cache_write_per_mtok_usd",
    "cache_read_per_mtok_usd",
]

# One JSONL log line.  Keys are matched case-sensitively by from_json.
_USAGE_STRUCT = T.StructType(
    [
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_creation_input_tokens", T.LongType()),
        T.StructField("cache_read_input_tokens", T.LongType()),
    ]
)
LOG_LINE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("requestId", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("gitBranch", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField(
            "message",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("model", T.StringType()),
                    T.StructField("usage", _USAGE_STRUCT),
                ]
            ),
        ),
    ]
)
LOG_LINE_WITH_CORRUPT = T.StructType(LOG_LINE.fields + [T.StructField("_corrupt", T.StringType())])

# The fact table.  ts is UTC wall-clock time without a zone; usage_date and
# project_key are materialised so date filters prune partitions and the
# project filter is a plain equality.
USAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("request_id", T.StringType()),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("project_slug", T.StringType(), False),
        T.StructField("cwd", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("model", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("input_tokens", T.LongType(), False),
        T.StructField("output_tokens", T.LongType(), False),
        T.StructField("cache_creation_tokens", T.LongType(), False),
        T.StructField("cache_read_tokens", T.LongType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_line", T.LongType(), False),
        T.StructField("project_key", T.StringType(), False),
        T.StructField("usage_date", T.DateType(), False),
    ]
)

PRICING = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("input_per_mtok_usd", T.DoubleType(), False),
        T.StructField("output_per_mtok_usd", T.DoubleType(), False),
        T.StructField("cache_write_per_mtok_usd", T.DoubleType(), False),
        T.StructField("cache_read_per_mtok_usd", T.DoubleType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

BUDGETS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("amount_usd", T.DoubleType(), False),
        T.StructField("show_in_dashboard", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

FEED_PRICING = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("input_cache_read", T.StringType()),
        T.StructField("input_cache_write", T.StringType()),
    ]
)
FEED_MODEL = T.StructType([T.StructField("id", T.StringType()), T.StructField("pricing", FEED_PRICING)])
FEED = T.StructType([T.StructField("data", T.ArrayType(FEED_MODEL))])
