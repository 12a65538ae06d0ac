"""Fallback model matching as one array expression (no UDF).

A usage model id is priced by the first id in its candidate list that has a
rate:

1. the id itself;
2. the id with a trailing ``-YYYYMMDD`` date stamp removed (kept even if the
   result has no dash, e.g. ``foo-20251001`` -> ``foo``);
3. the date-stripped id with its trailing numeric segments removed one at a
   time, as long as the result still contains a dash
   (``a-b-4-7`` -> ``a-b-4`` -> ``a-b``).

The list is built with split / transform / slice / array_join so it runs
inside whole-stage codegen on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# A date stamp is a dash and exactly eight digits at the very end of the id.
# ``\z`` (not ``$``) so a final newline is never treated as the end.
DATE_SUFFIX_PATTERN = r"-[0-9]{8}\z"
NUMERIC_SEGMENT_PATTERN = r"\A[0-9]+\z"
# ---------------------------------------------------------------------------


def _empty() -> Column:
    return F.array().cast("array<string>")


def strip_date_suffix(model: Column) -> Column:
    return F.regexp_replace(model, DATE_SUFFIX_PATTERN, "")


def walked_versions(base: Column) -> Column:
    """Ids obtained by dropping 1..k trailing numeric segments of ``base``.

    With ``n`` dash-separated segments and ``t`` trailing all-digit segments,
    dropping ``k`` segments is allowed for ``1 <= k <= min(t, n - 2)``: the
    result keeps at least two segments, i.e. still contains a dash.
    """
    segs = F.split(base, "-", -1)
    n = F.size(segs)
    flags = F.transform(F.reverse(segs), lambda s: s.rlike(NUMERIC_SEGMENT_PATTERN))
    first_non_numeric = F.array_position(flags, False)
    trailing = F.when(first_non_numeric == 0, n).otherwise(first_non_numeric - 1)
    k_max = F.least(trailing, n - 2)
    return F.when(
        k_max >= 1,
        F.transform(F.sequence(F.lit(1), k_max), lambda k: F.array_join(F.slice(segs, F.lit(1), n - k), "-")),
    ).otherwise(_empty())


def candidate_models(model: Column) -> Column:
    """Ordered candidate ids: exact, date-stripped (if different), walked."""
    stripped = strip_date_suffix(model)
    dated = F.when(stripped != model, F.array(stripped)).otherwise(_empty())
    return F.concat(F.array(model), dated, walked_versions(stripped))
