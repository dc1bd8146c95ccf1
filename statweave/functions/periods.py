"""Calendar helpers on date periods."""

from __future__ import annotations

import calendar
import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTIAL = re.compile(r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$")


def _parts(text: str) -> tuple[int, int | None, int | None]:
    match = _PARTIAL.match(text)
    if not match:
        raise ValueError(f"Period bound must be YYYY, YYYY-MM or YYYY-MM-DD: {text!r}")
    year, month, day = match.groups()
    return int(year), int(month) if month else None, int(day) if day else None


def _clamped(year: int, month: int, day: int, upwards: bool) -> dt.date | None:
    """The calendar day that gives the same answer as comparing ISO text with ``y-m-d``."""
    if year < 1:
        return dt.date.min if not upwards else None
    if month < 1:
        return dt.date(year, 1, 1) if not upwards else dt.date(year, 1, 1) - dt.timedelta(1) if year > 1 else None
    if month > 12:
        return dt.date(year, 12, 31) if upwards else (dt.date(year + 1, 1, 1) if year < 9999 else None)
    last = calendar.monthrange(year, month)[1]
    if day < 1:
        first = dt.date(year, month, 1)
        return first if not upwards else (first - dt.timedelta(1) if first > dt.date.min else None)
    if day > last:
        end = dt.date(year, month, last)
        return end if upwards else (end + dt.timedelta(1) if end < dt.date.max else None)
    return dt.date(year, month, day)


def range_predicate(period: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds given as year, month or day; typed date literals, so scans can prune.

    A bound with an impossible day behaves like the comparison of ISO texts would.
    """
    keep = F.lit(True)
    if start is not None:
        year, month, day = _parts(start)
        low = _clamped(year, 1 if month is None else month, 1 if day is None else day, upwards=False)
        keep = keep & (period >= F.lit(low) if low else F.lit(False))
    if end is not None:
        year, month, day = _parts(end)
        high = _clamped(year, 12 if month is None else month, 31 if day is None else day, upwards=True)
        keep = keep & (period <= F.lit(high) if high else F.lit(False))
    return keep


def year_bounds(start: str | None, end: str | None) -> tuple[int | None, int | None]:
    """Years that a range can touch, for partition pruning."""
    return (_parts(start)[0] if start else None, _parts(end)[0] if end else None)


def period_label(period: Column, frequency: Column) -> Column:
    """``YYYY-MM`` for monthly observations, ``YYYY`` for the rest."""
    return F.when(frequency == "monthly", F.date_format(period, "yyyy-MM")).otherwise(F.date_format(period, "yyyy"))


def month_sin(period: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.month(period) / F.lit(12.0))


def month_cos(period: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.month(period) / F.lit(12.0))


def month_index(period: Column) -> Column:
    """Months since year zero; consecutive months differ by one."""
    return F.year(period) * F.lit(12) + F.month(period)
