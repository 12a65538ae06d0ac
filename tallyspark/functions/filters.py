"""Request parameters -> one conjunctive Column predicate.

Date bounds are day-granular: a ``from`` keeps rows whose UTC day is on or
after the date written in the parameter, a ``to`` is exclusive midnight of a
day (a date-only ``to`` is advanced by one day first, so it includes that
day; an RFC 3339 ``to`` is not, so it excludes its own day).  The date of an
RFC 3339 value is the one written in its own offset.  Values that parse as
neither form are ignored.  Because the bounds are plain ``usage_date``
comparisons they prune ``usage_date`` partitions of a stored fact table and
push down to Parquet.

Everything here is evaluated on the driver once per request and yields
Column expressions only; no data is touched.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SYNTHETIC_MODEL

# --- fixed values -----------------------------------------------------------
# RFC 3339 date-time as accepted for from/to: 'T' separator, optional
# fraction, 'Z' or a numeric offset.
RFC3339_PATTERN = re.compile(
    r"\A(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})\Z"
)
DATE_PATTERN = re.compile(r"\A(\d{4})-(\d{2})-(\d{2})\Z")
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MAX = 500
# ASCII folding table: the search is case-insensitive for A-Z only.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------


def _valid_date(y: str, m: str, d: str) -> dt.date | None:
    try:
        return dt.date(int(y), int(m), int(d))
    except ValueError:
        return None


def _parse_rfc3339(text: str) -> tuple[dt.date, dt.datetime] | None:
    """(date as written, UTC instant) of a valid RFC 3339 value, else None."""
    m = RFC3339_PATTERN.match(text)
    if not m:
        return None
    y, mo, d, hh, mi, ss, frac, off = m.groups()
    day = _valid_date(y, mo, d)
    if day is None or int(hh) > 23 or int(mi) > 59 or int(ss) > 59:
        return None
    if off == "Z":
        tz = dt.timezone.utc
    else:
        oh, om = int(off[1:3]), int(off[4:6])
        if oh > 23 or om > 59:
            return None
        sign = 1 if off[0] == "+" else -1
        tz = dt.timezone(sign * dt.timedelta(hours=oh, minutes=om))
    micros = int((frac[1:] + "000000")[:6]) if frac else 0
    local = dt.datetime(day.year, day.month, day.day, int(hh), int(mi), int(ss), micros, tzinfo=tz)
    try:
        return day, local.astimezone(dt.timezone.utc).replace(tzinfo=None)
    except OverflowError:  # the instant lies before year 1 or after year 9999
        return day, dt.datetime.min if day.year == 1 else dt.datetime.max


def from_date(text: str | None) -> dt.date | None:
    """Inclusive lower day bound of a ``from`` parameter (None = no bound)."""
    if not text:
        return None
    parsed = _parse_rfc3339(text)
    if parsed:
        return parsed[0]
    m = DATE_PATTERN.match(text)
    return _valid_date(*m.groups()) if m else None


def to_date_exclusive(text: str | None) -> dt.date | None:
    """Exclusive upper day bound of a ``to`` parameter (None = no bound)."""
    if not text:
        return None
    parsed = _parse_rfc3339(text)
    if parsed:
        return parsed[0]
    m = DATE_PATTERN.match(text)
    day = _valid_date(*m.groups()) if m else None
    if day is None or day == dt.date.max:  # nothing lies behind the last day
        return None
    return day + dt.timedelta(days=1)


def ascii_fold(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def like_pattern(search: str) -> str:
    """``%search%`` with the user's own % and _ kept as wildcards.

    Spark's LIKE treats backslash as the escape character; the matched
    semantics have none, so a literal backslash is doubled.
    """
    return "%" + search.replace("\\", "\\\\") + "%"


def fold(text: str) -> str:
    return text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))


def search_fields() -> dict[str, Column]:
    """The searched columns; a missing path or branch counts as empty."""
    return {
        "project_slug": F.col("project_slug"),
        "cwd": F.coalesce(F.col("cwd"), F.lit("")),
        "git_branch": F.coalesce(F.col("git_branch"), F.lit("")),
        "model": F.col("model"),
        "session_id": F.col("session_id"),
    }


def text_matches(text: Column, search: str) -> Column:
    return ascii_fold(text).like(fold(like_pattern(search)))


def search_predicate(search: str) -> Column:
    return functools.reduce(operator.or_, [text_matches(c, search) for c in search_fields().values()])


def not_synthetic() -> Column:
    return F.col("model") != F.lit(SYNTHETIC_MODEL)


@dataclass(frozen=True)
class UsageFilter:
    """The optional request filters; ``predicate()`` is their conjunction."""

    date_from: str | None = None
    date_to: str | None = None
    project: str | None = None
    model: str | None = None
    search: str | None = None

    @property
    def from_day(self) -> dt.date | None:
        return from_date(self.date_from)

    @property
    def to_day(self) -> dt.date | None:
        return to_date_exclusive(self.date_to)

    def predicate(self) -> Column:
        preds = [not_synthetic()]
        if self.from_day is not None:
            preds.append(F.col("usage_date") >= F.lit(self.from_day))
        if self.to_day is not None:
            preds.append(F.col("usage_date") < F.lit(self.to_day))
        if self.project:
            preds.append(F.col("project_key") == F.lit(self.project))
        if self.model:
            preds.append(F.col("model") == F.lit(self.model))
        if self.search:
            preds.append(search_predicate(self.search))
        return functools.reduce(operator.and_, preds)

    def with_bounds(self, date_from: str | None, date_to: str | None) -> "UsageFilter":
        return UsageFilter(date_from, date_to, self.project, self.model, self.search)


def session_predicate(session_id: str) -> Column:
    return (F.col("session_id") == F.lit(session_id)) & not_synthetic()


# --- presets and comparison windows (driver-side, explicit as_of) ------------


def _iso(t: dt.datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def month_start(as_of: dt.datetime) -> dt.datetime:
    return dt.datetime(as_of.year, as_of.month, 1)


def preset_bounds(preset: str, as_of: dt.datetime, custom_from: str | None = None,
                  custom_to: str | None = None) -> tuple[str | None, str | None, str]:
    """(from, to, bucket) for a range preset; as_of is a UTC wall-clock time.

    24h/7d/30d start that long before ``as_of``; ``month`` starts at the UTC
    month start; ``custom`` passes the given values through; anything else is
    all time.  Only the 24h preset is bucketed by hour.
    """
    spans = {"24h": dt.timedelta(hours=24), "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30)}
    if preset in spans:
        return _iso(as_of - spans[preset]), None, "hour" if preset == "24h" else "day"
    if preset == "month":
        return _iso(month_start(as_of)), None, "day"
    if preset == "custom":
        return custom_from or None, custom_to or None, "day"
    return None, None, "day"


@dataclass(frozen=True)
class Comparison:
    current_from: str | None
    current_to: str | None
    previous_from: str
    previous_to: str
    label: str


def _parse_client_time(text: str) -> dt.datetime | None:
    parsed = _parse_rfc3339(text)
    if parsed:
        return parsed[1]
    m = DATE_PATTERN.match(text)
    day = _valid_date(*m.groups()) if m else None
    return dt.datetime(day.year, day.month, day.day) if day else None


def previous_period(cur_from: str | None, cur_to: str | None, as_of: dt.datetime) -> Comparison | None:
    """Window of the same length right before the current one.

    Without a current start ("all time") the comparison is this calendar
    month against the previous one.  None when the window has no length, or
    when the one before it would begin before year 1.
    """
    if not cur_from:
        this_month = month_start(as_of)
        prev_month = month_start(this_month - dt.timedelta(days=1))
        return Comparison(_iso(this_month), None, _iso(prev_month), _iso(this_month), "vs last month")
    start = _parse_client_time(cur_from)
    if start is None:
        return None
    end = _parse_client_time(cur_to) if cur_to else as_of
    if end is None:
        return None
    length = end - start
    if length <= dt.timedelta(0):
        return None
    days = math.floor(length.total_seconds() / 86400.0 + 0.5)  # half rounds up
    label = "vs previous 24 hours" if days <= 1 else f"vs previous {days} days"
    if start - dt.datetime.min < length:  # it would begin before year 1
        return None
    return Comparison(cur_from, cur_to, _iso(start - length), _iso(start), label)


def page_args(limit: str | int | None, offset: str | int | None) -> tuple[int, int]:
    """Limit outside 1..500 (or not an integer) -> 50; bad or negative offset -> 0."""

    def to_int(v):
        if isinstance(v, int):
            return v
        if v is None or not re.fullmatch(r"[+-]?\d+", str(v)):
            return None
        return int(v)

    lim, off = to_int(limit), to_int(offset)
    lim = lim if lim is not None and 0 < lim <= PAGE_LIMIT_MAX else PAGE_LIMIT_DEFAULT
    off = off if off is not None and off >= 0 else 0
    return lim, off
