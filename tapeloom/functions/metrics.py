"""Arithmetic on metrics. A missing input yields NULL, never a zero."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.config import RankWeights

#: Denominators at or below this are treated as absent.
EPSILON = 1e-9


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > EPSILON, numerator / denominator)


def pct_change(current: Column, reference: Column) -> Column:
    return F.when(reference > EPSILON, (current / reference - 1.0) * 100.0)


def gap_pct(price: Column, prev_close: Column, feed_change: Column) -> Column:
    """Change against the previous close, else the feed's own figure."""
    return F.coalesce(pct_change(price, prev_close), feed_change)


def window_volume(volume: Column, at_start: Column) -> Column:
    """Volume since the window opened; a falling counter reads as zero."""
    delta = volume - at_start
    return F.when(delta < 0, 0.0).otherwise(delta)


def rvol_baseline(volume: Column, baseline: Column) -> Column:
    return guarded_ratio(volume, baseline)


def rvol_fallback(volume: Column, average_volume: Column, fraction: float) -> Column:
    if fraction <= EPSILON:
        raise ValueError(f"session fraction must be positive, got {fraction}")
    return F.when(average_volume > EPSILON, volume / (average_volume * fraction))


def resolve_rvol(
    volume: Column, baseline: Column, average_volume: Column, fraction: float
) -> tuple[Column, Column]:
    """``(rvol, source)``: time-of-day baseline first, crude fallback second."""
    timed = rvol_baseline(volume, baseline)
    crude = rvol_fallback(volume, average_volume, fraction)
    source = (
        F.when(timed.isNotNull(), "baseline").when(crude.isNotNull(), "fallback")
        .otherwise("unknown")
    )
    return F.coalesce(timed, crude), source


def expected_volume(average_volume: Column, fraction: float) -> Column:
    return F.when(average_volume > 0, average_volume * fraction)


def dollar_volume(price: Column, volume: Column) -> Column:
    return price * volume


def float_turnover(volume: Column, float_shares: Column) -> Column:
    return F.when(float_shares > 0, volume / float_shares)


def float_confidence(
    float_shares: Column,
    turnover: Column,
    float_asof: Column,
    as_of: Column,
    turnover_low: float,
    max_age_days: int,
) -> Column:
    """Trust in a float figure; distrust is the default."""
    age_days = F.floor((F.unix_micros(as_of) - F.unix_micros(float_asof)) / 86_400_000_000)
    return (
        F.when(float_shares.isNull() | (float_shares <= 0), "low")
        .when(turnover > turnover_low, "low")
        .when(float_asof.isNull(), "medium")
        .when(age_days > max_age_days, "low")
        .otherwise("high")
    )


def rank_score(change: Column, rvol: Column, gap: Column, weights: RankWeights) -> Column:
    """Weighted mean of the ranks that are present."""
    parts = [
        (rank, weight)
        for rank, weight in ((change, weights.window_change), (rvol, weights.rvol),
                             (gap, weights.gap))
        if weight > 0
    ]
    total, mass = F.lit(0.0), F.lit(0.0)
    for rank, weight in parts:
        total = total + F.coalesce(rank * weight, F.lit(0.0))
        mass = mass + F.when(rank.isNotNull(), weight).otherwise(0.0)
    return F.when(mass > EPSILON, total / mass)


def adjust_price(value: Column, ratio: Column) -> Column:
    """A pre-split price on the post-split basis."""
    return F.when(ratio > EPSILON, value / ratio).otherwise(value)


def adjust_volume(value: Column, ratio: Column) -> Column:
    return F.when(ratio > EPSILON, value * ratio).otherwise(value)


def realised_pnl(action: Column, entry: Column, exit_: Column, size: Column) -> Column:
    return F.when(action == "traded", (exit_ - entry) * size)


def not_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def share_count(value: Column) -> Column:
    """Share counts arrive as doubles; nonsense becomes NULL."""
    return F.when(~F.isnan(value) & (value > 0), F.floor(value).cast("long"))


def instant(value: datetime) -> Column:
    """A timezone-aware Python instant as a literal."""
    if value.tzinfo is None:
        raise ValueError("naive instant")
    return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))
