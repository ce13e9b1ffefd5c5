"""Market wall-clock arithmetic on UTC instants."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.config import MARKET_TZ, SESSIONS, Window


def seconds_of(wall: str) -> int:
    """``"08:05"`` as seconds after midnight."""
    hours, minutes = wall.split(":")
    return int(hours) * 3600 + int(minutes) * 60


def et(ts: Column) -> Column:
    """The market wall clock of a UTC instant."""
    return F.from_utc_timestamp(ts, MARKET_TZ)


def et_date(ts: Column) -> Column:
    return F.to_date(et(ts))


def et_seconds(ts: Column) -> Column:
    """Market wall clock as seconds of the day, so comparisons are integers; one zone lookup."""
    return F.pmod(F.unix_seconds(et(ts)), F.lit(86400)).cast("int")


def et_instant(day: Column, wall: str) -> Column:
    """UTC instant of a market wall time on a date."""
    return et_instant_at(day, F.lit(seconds_of(wall)))


def et_instant_at(day: Column, seconds: Column) -> Column:
    naive = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds)
    return F.to_utc_timestamp(naive, MARKET_TZ)


def minutes_between(start: Column, end: Column) -> Column:
    """Signed minutes; negative when ``end`` precedes ``start``."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def minutes_since(ts: Column, wall: str = "04:00") -> Column:
    """Minutes from a wall time on the same market day."""
    return minutes_between(et_instant(et_date(ts), wall), ts)


def minute_offset(ts: Column, wall: str = "04:00") -> Column:
    """Whole minutes from the session start, never negative, stable across DST."""
    return F.greatest(F.lit(0), F.floor(minutes_since(ts, wall)).cast("int"))


def plus_minutes(ts: Column, minutes: int | Column) -> Column:
    step = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * 60_000_000)


def floor_minutes(ts: Column, minutes: int = 1) -> Column:
    """Start of the ``minutes``-long bucket holding ``ts``."""
    if minutes <= 0 or 60 % minutes:
        raise ValueError(f"bucket must divide an hour, got {minutes} minutes")
    span = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / span) * span)


def minute_marks(start: Column, end: Column) -> Column:
    """Array of every minute mark in ``[start, end)``."""
    first, last = floor_minutes(start), floor_minutes(end)
    return F.when(
        first < last,
        F.sequence(first, plus_minutes(last, -1), F.expr("interval 1 minute")),
    ).otherwise(F.array().cast("array<timestamp>"))


def session_of(ts: Column, sessions: Mapping[str, Window] = SESSIONS) -> Column:
    """Session name of an instant, NULL outside all of them."""
    clock = et_seconds(ts)
    out = None
    for name, (start, end) in sessions.items():
        inside = (clock >= seconds_of(start)) & (clock < seconds_of(end))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def in_any_window(ts: Column, windows: Iterable[Window]) -> Column:
    clock = et_seconds(ts)
    hit = F.lit(False)
    for start, end in windows:
        hit = hit | ((clock >= seconds_of(start)) & (clock < seconds_of(end)))
    return hit


def window_start(ts: Column, windows: Iterable[Window]) -> Column:
    """UTC start of the window an instant lies in, NULL outside every window."""
    clock, day = et_seconds(ts), et_date(ts)
    begins = [
        F.when(
            (clock >= seconds_of(start)) & (clock < seconds_of(end)), F.lit(seconds_of(start))
        )
        for start, end in windows
    ]
    return et_instant_at(day, F.coalesce(*begins))


def news_day_start(
    ts: Column,
    day_start: str = "04:00",
    previous_start: str = "16:00",
    regular_open: str = "09:30",
) -> Column:
    """Start of "today's news": the previous afternoon until the open, then today."""
    day = et_date(ts)
    return F.when(
        et_seconds(ts) < seconds_of(regular_open),
        et_instant(F.date_sub(day, 1), previous_start),
    ).otherwise(et_instant(day, day_start))


def visible_until(end: Column, now: Column, delay_minutes: int) -> Column:
    """Latest instant a delayed feed may serve."""
    return F.least(end, plus_minutes(now, -delay_minutes))


def wall_text(ts: Column, zone: str, pattern: str = "HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)
