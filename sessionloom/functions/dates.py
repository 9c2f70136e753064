"""Calendar expressions over UTC instants and explicit zones, plus driver-side period arithmetic."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_ts(ts: Column, tz: str) -> Column:
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(local_ts(ts, tz))


def local_hour(ts: Column, tz: str = "UTC") -> Column:
    return F.hour(local_ts(ts, tz)).cast("long")


def local_minute(ts: Column, tz: str = "UTC") -> Column:
    return F.minute(local_ts(ts, tz)).cast("long")


def local_clock(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local_ts(ts, tz), "h:mm a")


def ymd(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def week_ending(day: Column) -> Column:
    """The Sunday that closes the week of ``day`` (a Sunday closes its own week)."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def weekday(day: Column) -> Column:
    """0 = Sunday."""
    return (F.dayofweek(day) - 1).cast("long")


def day_span(first: Column, last: Column) -> Column:
    """Inclusive number of days."""
    return (F.datediff(last, first) + 1).cast("long")


# --- driver-side: literals for filters -------------------------------------


def resolve_period(preset: str, today: date, month: str | None = None) -> tuple[date, date]:
    """Inclusive range of a named period."""
    if preset == "today":
        return today, today
    if preset == "this-week":
        return today - timedelta(days=today.weekday()), today
    if preset == "this-month":
        return today.replace(day=1), today
    if preset == "last-month":
        end = today.replace(day=1) - timedelta(days=1)
        return end.replace(day=1), end
    if preset == "this-year":
        return date(today.year, 1, 1), today
    if preset == "month":
        if not month:
            raise ValueError("a month period needs YYYY-MM")
        year, number = (int(x) for x in month.split("-"))
        return date(year, number, 1), date(year, number, calendar.monthrange(year, number)[1])
    raise ValueError(f"unknown period {preset!r}")


def period_runs_to(preset: str, today: date) -> date | None:
    """Last day of a period that is still running; None when it has no horizon of its own."""
    if preset == "this-month":
        return today.replace(day=calendar.monthrange(today.year, today.month)[1])
    if preset == "this-week":
        return today + timedelta(days=6 - today.weekday())
    if preset == "this-year":
        return date(today.year, 12, 31)
    return None


def previous_window_start(first: date, last: date) -> date:
    return first - timedelta(days=(last - first).days + 1)


def days_ago(today: date, n: int) -> date:
    return today - timedelta(days=n - 1)


def choose_range(
    today: date,
    preset: str | None = None,
    days: int | None = None,
    first: date | None = None,
    last: date | None = None,
    month: str | None = None,
) -> tuple[date | None, date | None, date | None]:
    """(from, to, horizon): a preset wins over a day count, which wins over explicit bounds."""
    if preset:
        start, end = resolve_period(preset, today, month)
        return start, end, period_runs_to(preset, today)
    if days:
        return days_ago(today, days), last, None
    return first, last, None
