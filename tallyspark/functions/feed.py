"""Provider price-feed expressions: id normalisation and rate parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Only ids under this vendor prefix are priced; the prefix is removed.
VENDOR_PREFIX = "anthropic/"
# Ids with a variant suffix ("name:variant") are inference modes, not models.
VARIANT_MARK = ":"
# Feed prices are USD per token; the sheet holds USD per million tokens.
PER_MILLION = 1_000_000.0
# Cache prices default to these multiples of the input price when absent.
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.10
# Plain decimal / exponent numbers accepted as prices.
NUMBER_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITY_TEXTS = ["inf", "+inf", "infinity", "+infinity"]
NEG_INFINITY_TEXTS = ["-inf", "-infinity"]
NAN_TEXTS = ["nan", "+nan", "-nan"]
# ---------------------------------------------------------------------------


def is_vendor_model(feed_id: Column, prefix: str = VENDOR_PREFIX) -> Column:
    rest = F.substring(feed_id, len(prefix) + 1, 1 << 30)
    return feed_id.startswith(prefix) & ~rest.contains(VARIANT_MARK)


def normalised_model(feed_id: Column, prefix: str = VENDOR_PREFIX) -> Column:
    """Vendor prefix removed, dots turned into dashes (4.7 -> 4-7)."""
    return F.replace(F.substring(feed_id, len(prefix) + 1, 1 << 30), F.lit("."), F.lit("-"))


def per_million(text: Column) -> Column:
    """Per-token price text -> USD per million tokens.

    Empty, malformed or out-of-range text is 0; the words inf / infinity /
    nan are accepted as such.
    """
    t = F.lower(text)
    value = text.try_cast("double")
    finite = F.when(F.abs(value) == F.lit(float("inf")), F.lit(0.0)).otherwise(value * F.lit(PER_MILLION))
    return (
        F.when(text.isNull() | (text == ""), F.lit(0.0))
        .when(text.rlike(NUMBER_TEXT), F.coalesce(finite, F.lit(0.0)))
        .when(t.isin(*INFINITY_TEXTS), F.lit(float("inf")))
        .when(t.isin(*NEG_INFINITY_TEXTS), F.lit(float("-inf")))
        .when(t.isin(*NAN_TEXTS), F.lit(float("nan")))
        .otherwise(F.lit(0.0))
    )


def default_cache_write(write: Column, input_rate: Column) -> Column:
    return F.when(write == 0, input_rate * CACHE_WRITE_FACTOR).otherwise(write)


def default_cache_read(read: Column, input_rate: Column) -> Column:
    return F.when(read == 0, input_rate * CACHE_READ_FACTOR).otherwise(read)


def is_free(prompt_rate: Column, completion_rate: Column) -> Column:
    return (prompt_rate == 0) & (completion_rate == 0)
