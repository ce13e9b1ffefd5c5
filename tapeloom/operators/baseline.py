"""Relative-volume baselines: volume usually reached by this minute of the day.

One row per ticker, day and offset; the ten-day average is a range frame over
one row per day, so its partitions grow with the calendar and not the trades.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import BASELINE_DAYS
from tapeloom.functions import timegrid as tg
from tapeloom.operators.bars import DAY

KEY = ("ticker", "date", "minute_offset")
BarSource = Callable[[], DataFrame]


def cumulative_volume(bars: DataFrame) -> DataFrame:
    """Per bar: volume traded strictly before its minute offset."""
    offset = F.floor(tg.minutes_since(F.col("minute"))).cast("int")
    before = W.partitionBy(*DAY).orderBy("minute_offset").rangeBetween(W.unboundedPreceding, -1)
    placed = bars.select(*DAY, offset.alias("minute_offset"), "volume")
    return placed.withColumn("volume_before", F.sum("volume").over(before))


def daily_curve(bars: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Volume reached strictly before each offset, per ticker-day with bars."""
    if any(o < 0 for o in offsets):
        raise ValueError("offsets must be non-negative")
    offset = tg.minutes_since(F.col("minute"))
    points = [
        F.struct(
            F.lit(int(o)).alias("minute_offset"),
            F.coalesce(F.sum(F.when(offset < o, F.col("volume"))), F.lit(0.0)).alias("volume_before"),
        ) for o in offsets
    ]
    return bars.groupBy(*DAY).agg(F.array(*points).alias("_points")).select(
        *DAY, F.inline("_points"))


def baselines(
    fetch_bars: BarSource,
    calendar: DataFrame,
    offsets: Sequence[int],
    requested: DataFrame | None = None,
    days: int = BASELINE_DAYS,
) -> DataFrame:
    """Mean volume by offset over the previous ``days`` trading days.

    A day without bars drops out of the mean instead of counting as zero, and
    the day itself is never part of it. ``requested`` adds ``(ticker, date)``
    pairs that have no bars yet. Rows without a usable mean are left out.
    """
    curve = daily_curve(fetch_bars(), offsets)
    if requested is not None:
        grid = requested.select(*DAY).distinct().withColumn(
            "minute_offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
        curve = curve.unionByName(grid, allowMissingColumns=True).groupBy(*KEY).agg(
            F.max("volume_before").alias("volume_before"))
    dated = curve.join(calendar.select("date", "ord"), "date")
    past = W.partitionBy("ticker", "minute_offset").orderBy("ord").rangeBetween(-days, -1)
    mean = dated.select(
        *KEY,
        F.avg("volume_before").over(past).alias("baseline_volume"),
        F.count("volume_before").over(past).alias("days_used"),
    )
    return mean.where(F.col("baseline_volume") > 0)


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest computation wins per ticker, date and offset."""
    both = stored.unionByName(fresh)
    rest = [c for c in both.columns if c not in KEY]
    return both.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), F.col("computed_at")).alias("_row")).select(*KEY, "_row.*")


def invalidate(stored: DataFrame, affected: DataFrame) -> DataFrame:
    """Drop the baselines of ticker-days a split touched."""
    return stored.join(affected.select("ticker", "date"), ["ticker", "date"], "left_anti")


def lookup(requests: DataFrame, stored: DataFrame, computed: DataFrame, ts: str) -> DataFrame:
    """Stored baseline of a request, else the computed one, with its origin."""
    keyed = requests.withColumns({
        "date": tg.et_date(F.col(ts)), "minute_offset": tg.minute_offset(F.col(ts))})
    found = keyed.join(
        stored.select(*KEY, F.col("baseline_volume").alias("_cached")), list(KEY), "left"
    ).join(computed.select(*KEY, F.col("baseline_volume").alias("_new")), list(KEY), "left")
    return found.withColumns({
        "baseline_volume": F.coalesce("_cached", "_new"),
        "origin": F.when(F.col("_cached").isNotNull(), "cached")
        .when(F.col("_new").isNotNull(), "computed").otherwise("none"),
    }).drop("_cached", "_new")
