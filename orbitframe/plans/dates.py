"""Date expressions, folded to literals on the driver."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, datetime, timedelta

from ..errors import PlanError

_UNITS = {"day", "week", "month", "year"}


def _moved(day: date, unit: str, n: int) -> date:
    """n units later; the day of the month is clamped."""
    if unit in ("day", "week"):
        return day + timedelta(days=n * (7 if unit == "week" else 1))
    months = day.year * 12 + day.month - 1 + n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def _edge(first: date, unit: str, is_end: bool) -> date:
    return _moved(first, unit, 1) - timedelta(days=1) if is_end else first


def parse_bound(value: str | date | datetime | None, is_end: bool = False, today: date | None = None) -> date | None:
    """A day from an ISO date, year, year-month, today / yesterday / tomorrow, 'N units ago', or 'this|last week|month|year'.

    An expression for a span gives its first day, or its last one if is_end.  Weeks begin on Monday.  Other text is a PlanError.
    """
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    text, now = " ".join(value.lower().split()), today or date.today()
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return date.fromisoformat(text)
        if re.fullmatch(r"\d{4}", text):
            return _edge(date(int(text), 1, 1), "year", is_end)
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})", text):
            return _edge(date(int(m[1]), int(m[2]), 1), "month", is_end)
    except ValueError as e:
        raise PlanError(f"invalid date {value!r}") from e
    if text in ("now", "today", "yesterday", "tomorrow"):
        return now + timedelta(days={"yesterday": -1, "tomorrow": 1}.get(text, 0))
    words = text.split()
    if len(words) == 3 and words[2] == "ago" and words[1].removesuffix("s") in _UNITS and (words[0] in ("a", "an") or words[0].isdigit()):
        return _moved(now, words[1].removesuffix("s"), -(int(words[0]) if words[0].isdigit() else 1))
    if len(words) == 2 and words[0] in ("this", "last") and words[1] in _UNITS - {"day"}:
        unit, back = words[1], words[0] == "last"
        start = now - timedelta(days=now.weekday()) if unit == "week" else now.replace(day=1, month=1 if unit == "year" else now.month)
        return _edge(_moved(start, unit, -int(back)), unit, is_end)
    raise PlanError(f"unrecognised date {value!r}", hint="Use 2024-03-01, 2024-03, 2024, today, '3 months ago' or 'last week'.")


def parse_interval(value: str | None) -> tuple[date | None, date | None]:
    """A STAC interval: one instant, or two with / between; .. or nothing leaves an end open.  Times of day are cut off."""
    if not value:
        return None, None
    parts = value.split("/")
    if len(parts) > 2:
        raise PlanError(f"invalid interval {value!r}")

    def day(text: str) -> date | None:
        text = text.strip()
        if text in ("", ".."):
            return None
        try:
            return date.fromisoformat(text[:10])
        except ValueError as e:
            raise PlanError(f"invalid interval {value!r}") from e

    ends = [day(p) for p in parts]
    return (ends[0], ends[0]) if len(ends) == 1 else (ends[0], ends[1])
