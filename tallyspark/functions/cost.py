"""Cost arithmetic.

Cost is linear in the four token counters, so it is computed on token *sums*
after aggregation (one multiplication per group, not per row).  The
multiplication order is fixed -- tokens x rate / 1e6, summed in counter
order -- so that every report that prices the same sums yields the same
double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RATE_COLUMNS, TOKEN_COLUMNS

PER_MILLION = 1_000_000.0


def cost_usd(tokens: list[str] | None = None, rates: list[str] | None = None) -> Column:
    """Sum over categories of tokens x rate / 1e6; 0 when no rate matched."""
    tokens = tokens or TOKEN_COLUMNS
    rates = rates or RATE_COLUMNS
    total = None
    for t, r in zip(tokens, rates):
        term = F.col(t).cast("double") * F.col(r) / F.lit(PER_MILLION)
        total = term if total is None else total + term
    return F.coalesce(total, F.lit(0.0))


def token_total(prefix: str = "") -> Column:
    return sum((F.col(prefix + c) for c in TOKEN_COLUMNS[1:]), F.col(prefix + TOKEN_COLUMNS[0]))
