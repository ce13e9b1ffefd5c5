"""Trading calendar operators.

Calendars have one row per day, so the ordinal windows and the joins on it are
bounded by the length of history, whatever the number of tickers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import DISPLAY_TZ, MARKET_TZ, Window
from tapeloom.functions import timegrid as tg
from tapeloom.session import written_once


def with_hours(days: DataFrame, early_close: Column, close: str = "16:00",
               half_day_close: str = "13:00") -> DataFrame:
    """Open and close instants per trading day, half days closing early."""
    day = F.col("date")
    return days.withColumns({
        "early_close": early_close,
        "open_utc": tg.et_instant(day, "09:30"),
        "close_utc": F.when(early_close, tg.et_instant(day, half_day_close))
        .otherwise(tg.et_instant(day, close)),
    })


def during_regular_hours(events: DataFrame, hours: DataFrame, ts: str = "ts") -> DataFrame:
    """Events inside the regular session of a trading day."""
    kept = events.join(hours.select("date", "open_utc", "close_utc"), "date")
    inside = (F.col(ts) >= F.col("open_utc")) & (F.col(ts) < F.col("close_utc"))
    return kept.where(inside).drop("open_utc", "close_utc")


def sessions_upto(marks: DataFrame, days: DataFrame) -> DataFrame:
    """``date, _upto``: trading days up to and on each date of ``marks``, a trading day or not.

    The window has one row per calendar day and distinct mark.
    """
    in_order = W.orderBy("date").rangeBetween(W.unboundedPreceding, W.currentRow)
    return (
        marks.select("date").distinct().withColumn("_n", F.lit(0))
        .unionByName(days.select("date", F.lit(1).alias("_n")))
        .select("date", "_n", F.sum("_n").over(in_order).alias("_upto"))
        .where(F.col("_n") == 0).drop("_n")
    )


def expiry(entries: DataFrame, days: DataFrame, run_date: str, keep_days: int) -> DataFrame:
    """``expires_on``: the ``keep_days``-th trading day after ``run_date``.

    Past the end of the calendar it is the last known day, and never earlier
    than the run itself. Entries are written once: their days are placed first, then all of them joined.
    """
    entries = written_once(entries, "entries")
    placed = sessions_upto(entries.select(F.col(run_date).alias("date")), days)
    last = days.agg(F.max("date")).scalar()
    ahead = days.select((F.col("ord") - keep_days).alias("_upto"), F.col("date").alias("_later"))
    dated = placed.join(ahead, "_upto", "left").select(
        F.col("date").alias(run_date),
        F.coalesce("_later", F.greatest(F.col("date"), last)).alias("expires_on"),
    )
    return entries.join(dated, run_date)


def previous_days(days: DataFrame, count: int) -> DataFrame:
    """Each trading day with up to ``count`` trading days strictly before it."""
    steps = days.select(
        F.col("date").alias("day"),
        F.explode(F.sequence(F.col("ord") - count, F.col("ord") - 1)).alias("ord"),
    )
    return steps.join(days, "ord").select("day", F.col("date").alias("previous_day"))


def _open_windows(hours: DataFrame, windows: Iterable[Window]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(start).alias("wall"), tg.et_instant(F.col("date"), start).alias("starts_at"),
                 tg.et_instant(F.col("date"), end).alias("ends_at"))
        for start, end in windows
    ])
    rows = hours.select("date", "early_close", "close_utc", F.inline(cells))
    closed = F.col("early_close") & (F.col("starts_at") >= F.col("close_utc"))
    return rows.where(~closed)


def windows_of(hours: DataFrame, windows: Iterable[Window]) -> DataFrame:
    """One row per trading day and window with its UTC bounds.

    ``hours`` comes from :func:`with_hours`; a half day loses the windows that
    start at or after its close.
    """
    return _open_windows(hours, windows).select(
        F.col("date").alias("day"), "wall", "starts_at", "ends_at")


def expected_polls(hours: DataFrame, windows: Iterable[Window], cadence_minutes: int) -> DataFrame:
    """``(date, slot)``: the instants at which a poll is due, every so many minutes of a window.

    A half day ends at its close. Slots are unfolded from the days inside the
    task; a window shorter than the cadence has one.
    """
    if cadence_minutes <= 0:
        raise ValueError(f"cadence must be positive, got {cadence_minutes}")
    end = F.when(F.col("early_close"), F.least("ends_at", "close_utc")).otherwise(F.col("ends_at"))
    slots = F.ceil(tg.minutes_between(F.col("starts_at"), end) / cadence_minutes)
    steps = F.sequence(F.lit(0), (slots - 1).cast("int"))
    return _open_windows(hours, windows).where(F.col("starts_at") < end).select(
        "date", "starts_at", F.explode(steps).alias("_step")).select(
        "date", tg.plus_minutes(F.col("starts_at"), F.col("_step") * cadence_minutes).alias("slot"))


def poll_slot(at: Column, windows: Iterable[Window], cadence_minutes: int) -> Column:
    """The slot of :func:`expected_polls` an instant falls into, NULL outside every window."""
    start = tg.window_start(at, windows)
    return tg.plus_minutes(
        start, F.floor(tg.minutes_between(start, at) / cadence_minutes) * cadence_minutes)


def next_windows(hours: DataFrame, windows: Iterable[Window], as_of: Column, n: int) -> DataFrame:
    """The next ``n`` windows that start after ``as_of``: as many as the calendar has ahead."""
    ahead = hours.where(F.col("date") >= tg.et_date(as_of))
    return windows_of(ahead, windows).where(F.col("starts_at") > as_of).orderBy("starts_at").limit(n)


def window_text(start: Column, end: Column, display_tz: str = DISPLAY_TZ) -> Column:
    """A window in market time and in a second zone, on one line."""
    return F.concat(
        tg.wall_text(start, MARKET_TZ, "EEE dd MMM HH:mm"), F.lit("-"),
        tg.wall_text(end, MARKET_TZ), F.lit(" ET ("),
        tg.wall_text(start, display_tz), F.lit(f" {display_tz})"))
