"""Date rules of the query language, for the driver side."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

UNITS = {"h": 1 / 24, "d": 1.0, "w": 7.0}
#: The phrases of relative time, in the order in which they are looked for.
PHRASES = ["this month", "last month", "this week", "last week", "yesterday", "today", "last year"]


def parse_date(text: str) -> datetime:
    """A day (midnight UTC) or an RFC 3339 time, in UTC; anything else is a ValueError."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        d = date.fromisoformat(text)
        return datetime(d.year, d.month, d.day, tzinfo=UTC)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})", text):
        raise ValueError(f"{text!r} is no date: use YYYY-MM-DD or RFC 3339")
    return datetime.fromisoformat(text.upper().replace("Z", "+00:00")).astimezone(UTC)


def shifted(t: datetime, years: int = 0, months: int = 0) -> datetime:
    """Calendar arithmetic in which a day that a month lacks runs over into the next."""
    month = t.month - 1 + months + 12 * years
    first = t.replace(year=t.year + month // 12, month=month % 12 + 1, day=1)
    return first + timedelta(days=t.day - 1)


def relative_range(phrase: str, now: datetime) -> tuple[datetime, datetime]:
    """[start, end) of a phrase of relative time; weeks begin on Mondays, a last year is rolling."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    week = day - timedelta(days=day.weekday())
    month = day.replace(day=1)
    ranges = {
        "today": (day, now),
        "yesterday": (day - timedelta(days=1), day),
        "this week": (week, now),
        "last week": (week - timedelta(days=7), week),
        "this month": (month, now),
        "last month": (shifted(month, months=-1), month),
        "last year": (shifted(now, years=-1), now),
    }
    if phrase not in ranges:
        raise ValueError(f"unknown time phrase {phrase!r}")
    return ranges[phrase]


def lookback(text: str, now: datetime, most_days: int = 3650) -> datetime:
    """The time that ``7d``, ``24h``, ``2w``, a day or an RFC 3339 time names; it must lie before now."""
    if m := re.fullmatch(r"(\d+)([hdw])", text.strip()):
        days = int(m[1]) * UNITS[m[2]]
        if not 0 < days <= most_days:
            raise ValueError(f"{text!r} is out of range")
        return now - timedelta(days=days)
    t = parse_date(text.strip())
    if t >= now:
        raise ValueError(f"{text!r} is not in the past")
    return t
