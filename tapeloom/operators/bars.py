"""Bars: building, session rollups, thinning and the shape of a day.

Windows here run over ``(ticker, date)`` of *bars*: at most one row per minute
of a day whatever the number of trades, because the trades were folded into
bars by a map-side combined aggregate first. That bound holds for any key.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import SESSIONS, Window
from tapeloom.functions import timegrid as tg
from tapeloom.functions.metrics import EPSILON, pct_change

DAY = ("ticker", "date")


def trade_order(ts: Column, event_id: Column) -> Column:
    """Time in microseconds and, behind it, the id (null: none), as a 38-digit number."""
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return (micros * F.lit(Decimal(10**19)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.coalesce(
        event_id, F.lit(0)).cast("decimal(19,0)")


def build_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """OHLCV bars from trades ``(ticker, ts, event_id, price, volume)``.

    Trades are ordered by time, then id, in one number of fixed width, so that
    Spark folds them in a hash table and never sorts them.
    """
    order = trade_order(F.col("ts"), F.col("event_id"))
    return (
        ticks.groupBy(
            "ticker", tg.et_date(F.col("ts")).alias("date"),
            tg.floor_minutes(F.col("ts"), minutes).alias("minute"),
        )
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )


def _weighted() -> Column:
    return F.coalesce(F.col("vwap"), F.col("close")) * F.col("volume")


def session_rollup(bars: DataFrame, sessions: Mapping[str, Window] = SESSIONS) -> DataFrame:
    """One OHLCV row per ticker, date and session that traded."""
    return (
        bars.withColumn("session", tg.session_of(F.col("minute"), sessions))
        .where(F.col("session").isNotNull())
        .groupBy(*DAY, "session")
        .agg(
            F.min_by("open", "minute").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "minute").alias("close"),
            F.sum("volume").alias("volume"),
            F.when(F.sum("volume") > EPSILON, F.sum(_weighted()) / F.sum("volume")).alias("vwap"),
            F.count(F.lit(1)).alias("bar_count"),
        )
    )


def dense_rollup(bars: DataFrame, sessions: Mapping[str, Window] = SESSIONS) -> DataFrame:
    """Always one row per session: silence is volume 0 with NULL prices.

    The sessions are folded into one aggregate per ticker-day and unfolded
    afterwards, so no grid is joined.
    """
    session = tg.session_of(F.col("minute"), sessions)
    tagged = bars.withColumn("session", session)

    def only(name: str, col: Column) -> Column:
        return F.when(F.col("session") == name, col)

    cells = []
    for name in sessions:
        volume = F.coalesce(F.sum(only(name, F.col("volume"))), F.lit(0.0))
        cells.append(F.struct(
            F.lit(name).alias("session"),
            F.min_by("open", only(name, F.col("minute"))).alias("open"),
            F.max(only(name, F.col("high"))).alias("high"),
            F.min(only(name, F.col("low"))).alias("low"),
            F.max_by("close", only(name, F.col("minute"))).alias("close"),
            volume.alias("volume"),
            F.when(volume > EPSILON, F.sum(only(name, _weighted())) / volume).alias("vwap"),
            F.count(only(name, F.lit(1))).alias("bar_count"),
        ))
    folded = tagged.groupBy(*DAY).agg(F.array(*cells).alias("_cells"))
    return folded.select(*DAY, F.inline("_cells"))


def path_extremes(bars: DataFrame) -> DataFrame:
    """Per bar: lowest low and highest high so far, and the move from each."""
    so_far = W.partitionBy(*DAY).orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    low, high = F.min("low").over(so_far), F.max("high").over(so_far)
    return (
        bars.withColumn("low_so_far", low)
        .withColumn("high_so_far", high)
        .withColumn("runup_pct", pct_change(F.col("high"), F.col("low_so_far")))
        .withColumn("drawdown_pct", pct_change(F.col("low"), F.col("high_so_far")))
    )


def move_metrics(
    bars: DataFrame,
    prev_close: DataFrame | None = None,
    as_of: str | None = None,
    day_start: str = "04:00",
    edges: DataFrame | None = None,
) -> DataFrame:
    """The day's shape per ticker, relative to the previous close.

    ``prev_close`` is ``(ticker, date, prev_close)``; ``as_of`` a market wall
    time after which bars are invisible; ``edges`` is
    ``(ticker, date, pre_open, post_close)`` for the drift across the day.
    """
    if as_of is not None:
        bars = bars.where(F.col("minute") <= tg.et_instant(F.col("date"), as_of))
    first_high = F.min_by("minute", F.struct(-F.col("high"), F.col("minute")))
    shape = path_extremes(bars).groupBy(*DAY).agg(
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        F.max_by("close", "minute").alias("session_close"),
        F.max("runup_pct").alias("max_runup_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        first_high.alias("high_minute"),
        F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
        F.count(F.lit(1)).alias("bar_count"),
    )
    if prev_close is not None:
        shape = shape.join(prev_close.select(*DAY, "prev_close"), list(DAY), "left")
    else:
        shape = shape.withColumn("prev_close", F.lit(None).cast("double"))
    if edges is not None:
        shape = shape.join(edges.select(*DAY, "pre_open", "post_close"), list(DAY), "left")
    else:
        shape = shape.withColumns({
            "pre_open": F.lit(None).cast("double"), "post_close": F.lit(None).cast("double")
        })
    prev = F.col("prev_close")
    return shape.select(
        *DAY,
        pct_change(F.col("day_high"), prev).alias("up_move_pct"),
        pct_change(F.col("day_low"), prev).alias("down_move_pct"),
        F.when(prev > EPSILON, (F.col("day_high") - F.col("day_low")) / prev * 100.0)
        .alias("range_pct"),
        "max_runup_pct",
        "max_drawdown_pct",
        pct_change(F.col("post_close"), F.col("pre_open")).alias("pre_to_post_pct"),
        pct_change(F.col("session_close"), F.col("day_high")).alias("fade_pct"),
        tg.minutes_since(F.col("high_minute"), day_start).alias("minutes_to_high"),
        "day_high", "day_low", "session_close", "dollar_volume", "prev_close", "bar_count",
    )


def thin_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Re-bucket bars to ``minutes``; vwap cannot be rebuilt and stays NULL."""
    trades = F.sum("trade_count")
    return (
        bars.groupBy("ticker", "date", tg.floor_minutes(F.col("minute"), minutes).alias("bucket"))
        .agg(
            F.min_by("open", "minute").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "minute").alias("close"),
            F.sum("volume").alias("volume"),
            F.when(trades != 0, trades).alias("trade_count"),
        )
        .withColumnRenamed("bucket", "minute")
        .withColumn("vwap", F.lit(None).cast("double"))
        .withColumn("resolution_minutes", F.lit(minutes))
    )


def regular_closes(bars: DataFrame) -> DataFrame:
    """Regular-session close per ticker-day with the one before it.

    The lag runs over one row per ticker and day.
    """
    daily = session_rollup(bars, {"regular": SESSIONS["regular"]}).select(
        *DAY, "open", "high", "low", "close", "volume"
    )
    return daily.withColumn(
        "prev_close", F.lag("close").over(W.partitionBy("ticker").orderBy("date"))
    )


def reference_times(days: DataFrame, walls: tuple[str, ...], now: Column | None = None) -> DataFrame:
    """One row per ticker-day and reference time that is not in the future."""
    moments = F.array(*[tg.et_instant(F.col("date"), wall) for wall in walls])
    grid = days.withColumn("reference_ts", F.explode(moments))
    return grid if now is None else grid.where(F.col("reference_ts") <= now)
