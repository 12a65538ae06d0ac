"""Rate lookup with fallback matching, and pricing of aggregated usage.

Plan shape for a priced aggregate (what ``price_groups`` builds):

    usage --filter--> HashAggregate(keys, model)    [one shuffle, map-side combine]
          --> Generate posexplode(candidates)       [~3 rows per group]
          --> BroadcastHashJoin(rate sheet)         [sheet size checked]
          --> HashAggregate(keys, model, measures)  [no exchange: same clustering]
          --> matched id + cost columns

Tokens are summed first and priced once per group: cost is linear, and
Catalyst would not move the multiplication below the join by itself.  The
second aggregate picks, per group, the rates of the matched candidate with
the smallest position using fixed-width buffers (``min_by(rate, position)``
and ``min(position)``), so it runs as a code-generated hash aggregate inside
the same stage; the first aggregate's hash partitioning on (keys, model)
already clusters it.  The whole report stays a single scan.

Raw rows (one drill-down listing) are priced through a model -> rate map
built from their distinct models instead, so the candidate list is expanded
once per model rather than once per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import cost_usd
from ..functions.matching import candidate_models
from ..schemas import RATE_COLUMNS, TOKEN_COLUMNS

# A rate sheet has one row per priced model id.  Above this many rows it is
# not broadcast and the lookup becomes a shuffled join instead.
BROADCAST_MAX_ROWS = 200_000


@dataclass
class RateSheet:
    """A price sheet DataFrame plus a once-computed broadcast decision."""

    df: DataFrame
    max_broadcast_rows: int = BROADCAST_MAX_ROWS
    known_rows: int | None = None  # row count known by construction (e.g. built from a driver list)
    _small: bool | None = field(default=None, repr=False)

    @property
    def small(self) -> bool:
        if self._small is None and self.known_rows is not None:
            self._small = self.known_rows <= self.max_broadcast_rows
        if self._small is None:
            n = self.df.select("model").limit(self.max_broadcast_rows + 1).count()
            self._small = n <= self.max_broadcast_rows
        return self._small

    def lookup_side(self) -> DataFrame:
        side = self.df.select(F.col("model").alias("_cand"), *RATE_COLUMNS)
        return F.broadcast(side) if self.small else side


def as_sheet(rates: DataFrame | RateSheet) -> RateSheet:
    return rates if isinstance(rates, RateSheet) else RateSheet(rates)


def _pick_rates(grouped: DataFrame, sheet: RateSheet) -> DataFrame:
    """Per row of ``grouped`` (unique rows with a ``model`` column): the rates
    of the first candidate id that the sheet prices, and that id."""
    carried = list(grouped.columns)
    cands = candidate_models(F.col("model"))
    exploded = grouped.select(*carried, F.posexplode(cands).alias("_pos", "_candidate"))
    joined = exploded.join(sheet.lookup_side(), F.col("_cand") == F.col("_candidate"), "left")
    # Position of a matched candidate, null for misses (ignored by min / min_by).
    hit = F.when(F.col("_cand").isNotNull(), F.col("_pos"))
    picked = joined.groupBy(*carried).agg(
        F.min(hit).alias("_hit"), *[F.min_by(F.col(c), hit).alias(c) for c in RATE_COLUMNS]
    )
    matched = F.when(F.col("_hit").isNotNull(), F.element_at(cands, F.col("_hit") + 1))
    return picked.select(*carried, matched.alias("matched_model"), *RATE_COLUMNS)


def rate_map(models: DataFrame, sheet: DataFrame | RateSheet) -> DataFrame:
    """model -> matched_model + rates, for the distinct model ids of ``models``."""
    return _pick_rates(models.select("model").distinct(), as_sheet(sheet))


def price_groups(grouped: DataFrame, keys: list[str], sheet: DataFrame | RateSheet, with_cost: bool = True) -> DataFrame:
    """Attach matched_model, the 4 rates and ``cost_usd`` to per-(keys, model) sums.

    ``grouped`` has one row per ``keys + ['model']`` plus the token sums and
    any other per-group measures; they are carried through.
    """
    priced = _pick_rates(grouped, as_sheet(sheet))
    return priced.withColumn("cost_usd", cost_usd()) if with_cost else priced


def price_rows(rows: DataFrame, sheet: DataFrame | RateSheet) -> DataFrame:
    """Per-row cost through a model -> rate map of the rows' distinct models.

    The map has one row per model id; its join back to the rows carries no
    hint, so AQE broadcasts it from its runtime size (shuffled join beyond).
    """
    m = rate_map(rows, sheet)
    return rows.join(m, "model", "left").withColumn("cost_usd", cost_usd())


def sum_tokens() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOKEN_COLUMNS]
