"""Period ids of single instants, on the driver: they become literals that reach the Parquet scan."""

from __future__ import annotations

from datetime import date, timedelta

from tallyforge.schemas import DEFAULT_PERIOD_NS, NS_PER_DAY, NS_PER_WEEK


def period_of(ts_ns: int, period_type: str = "fixed", cycle_day: int = 0, period_ns: int = 0) -> int:
    """As ``functions.scalars.resolve_period``, for one instant."""
    if period_type == "week":
        ts_ns, period_ns = ts_ns + 3 * NS_PER_DAY, NS_PER_WEEK
    elif period_type == "day":
        period_ns = NS_PER_DAY
    if ts_ns <= 0:
        return 0
    if period_type != "calendar":
        return ts_ns // (period_ns or DEFAULT_PERIOD_NS)
    on = date(1970, 1, 1) + timedelta(days=ts_ns // NS_PER_DAY)
    return max(0, (on.year - 2000) * 12 + on.month - 1 - (on.day < (cycle_day or 1)))


def period_range(start_ns: int, end_ns: int, period_type: str = "fixed", cycle_day: int = 0, period_ns: int = 0) -> tuple[int, int]:
    """First and last period that [start, end) touches; an empty range touches the period of its start."""
    first = period_of(start_ns, period_type, cycle_day, period_ns)
    return first, first if end_ns <= start_ns else period_of(end_ns - 1, period_type, cycle_day, period_ns)
