"""Halts, corporate actions, spreads and suspect prices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import TradabilityRules, Window
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators.bars import DAY, reference_times
from tapeloom.operators.scan import asof_join, running


def with_gaps(bars: DataFrame, min_silent: float, bar_minutes: int = 1,
              sessions: Mapping[str, Window] | None = None) -> DataFrame:
    """Add ``halt_start`` and ``halt_end`` to the bar that ends a silence.

    With ``sessions`` only silences between two bars of the same named session
    count, since thin names are quiet outside regular hours without a halt.
    The lag runs over the bars of one ticker-day.
    """
    previous = F.lag("minute").over(W.partitionBy(*DAY).orderBy("minute"))
    start = tg.plus_minutes(F.col("_prev"), bar_minutes)
    silent = tg.minutes_between(start, F.col("minute"))
    is_halt = silent >= min_silent
    if sessions is not None:
        here = tg.session_of(F.col("minute"), sessions)
        is_halt = is_halt & (here == tg.session_of(F.col("_prev"), sessions))
    gaps = bars.withColumn("_prev", previous)
    return gaps.withColumns({
        "halt_start": F.when(is_halt, start), "halt_end": F.when(is_halt, F.col("minute")),
    }).drop("_prev")


def infer_halts(bars: DataFrame, min_silent: float, bar_minutes: int = 1,
                sessions: Mapping[str, Window] | None = None) -> DataFrame:
    return with_gaps(bars, min_silent, bar_minutes, sessions).where(
        F.col("halt_start").isNotNull()
    ).select(*DAY, "halt_start", "halt_end", F.lit(True).alias("inferred"))


def halt_summary(halts: DataFrame) -> DataFrame:
    minutes = tg.minutes_between(F.col("halt_start"), F.col("halt_end"))
    return halts.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("halt_count"), F.sum(minutes).alias("halt_minutes"))


def state_at(polls: DataFrame, bars: DataFrame, min_silent: float, bar_minutes: int = 1,
             at: str = "poll_ts", sessions: Mapping[str, Window] | None = None) -> DataFrame:
    """What the bars say at each poll: ``halt_status``, ``inferred_halt``, ``bar_spread_pct``.

    Only bars that had ended by the poll count, so cutting the data there changes
    nothing: a silence is known once it has lasted ``min_silent`` minutes,
    whatever ends it later. Before the day's first bar the status is ``unknown``
    and the flag NULL; with ``sessions`` also where poll and last bar do not lie
    in one named session. One as-of scan, one row per poll.
    """
    ended = bars.select(
        *DAY, "minute", "high", "low", tg.plus_minutes(F.col("minute"), bar_minutes).alias("_ended"))
    found = asof_join(polls, ended, list(DAY), at, "_ended", ["_ended", "minute", "high", "low"],
                      out="_bar")
    known = F.col("_bar._ended").isNotNull()
    if sessions is not None:
        together = tg.session_of(F.col(at), sessions) == tg.session_of(F.col("_bar.minute"), sessions)
        known = known & F.coalesce(together, F.lit(False))
    silent = tg.minutes_between(F.col("_bar._ended"), F.col(at)) >= min_silent
    return found.withColumns({
        "halt_status": F.when(~known, "unknown").when(silent, "halted").otherwise("trading"),
        "inferred_halt": F.when(known, silent),
        "bar_spread_pct": spread_estimate(F.col("_bar.high"), F.col("_bar.low")),
    }).drop("_bar")


def covers(moment: Column, start: Column, end: Column) -> Column:
    """Half-open containment."""
    return (start <= moment) & (moment < end)


def action_on(days: DataFrame, actions: DataFrame) -> DataFrame:
    """The corporate action effective on a ticker-day, if any."""
    on_day = actions.groupBy("ticker", F.col("effective_date").alias("date")).agg(
        F.min_by(F.struct("action_type", "ratio"),
                 F.struct("action_type", "ratio")).alias("_a"))
    return days.join(on_day, ["ticker", "date"], "left").select(
        *days.columns, F.col("_a.action_type").alias("action_type"), F.col("_a.ratio").alias("ratio"))


def days_since_reverse_split(days: DataFrame, actions: DataFrame,
                             horizon_days: int = 365) -> DataFrame:
    """Calendar days since the latest reverse split, NULL beyond the horizon.

    An as-of join: only the latest one matters, so no range of pairs is built.
    """
    reverse = actions.where(rules.is_reverse_split(F.col("action_type"), F.col("ratio"))).select(
        "ticker", "effective_date", F.col("effective_date").cast("timestamp").alias("_eff"))
    probes = days.withColumn("_day", F.col("date").cast("timestamp"))
    found = asof_join(probes, reverse, ["ticker"], "_day", "_eff", ["effective_date"],
                      chunk_unit="month", out="_split")
    since = F.datediff(F.col("date"), F.col("_split.effective_date"))
    return found.select(
        *days.columns, F.when(since <= horizon_days, since).alias("days_since_reverse_split"))


def baselines_to_recompute(actions: DataFrame) -> DataFrame:
    """Ticker-days whose volume baseline a split invalidates."""
    return actions.where(rules.is_split(F.col("action_type"))).select(
        "ticker", F.col("effective_date").alias("date")).distinct()


def adjusted_close(close: Column, action_type: Column, ratio: Column) -> Column:
    """A stored close on today's basis, when today is a split day."""
    return F.when(F.coalesce(rules.is_split(action_type), F.lit(False)),
                  m.adjust_price(close, ratio)).otherwise(close)


def split_ratio(rows: DataFrame, actions: DataFrame, day: str = "date",
                out: str = "split_ratio") -> DataFrame:
    """Add the ratio that puts each row on the basis after every later split of its ticker.

    Several splits compound, one row in gives one row out, and rows without a
    later split get 1. A split on the row's own day is not later; a missing or
    zero ratio changes nothing. One running product from the newest day back,
    no pairs of rows and actions.
    """
    back = lambda c: -F.unix_date(F.col(c).cast("date"))
    history = rows.select(
        "ticker", back(day).alias("_back"), F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in rows.columns]).alias("_row"),
        F.lit(None).cast("double").alias("_ratio"))
    ratio = F.col("ratio").cast("double")
    splits = actions.where(ratio > m.EPSILON).select(
        "ticker", back("effective_date").alias("_back"), F.lit(1).alias("_side"),
        F.lit(None).cast(history.schema["_row"].dataType).alias("_row"), ratio.alias("_ratio"))
    scanned = running(history.unionByName(splits), ["ticker"], F.col("_back"), ["_back", "_side"],
                      {out: ("product", F.col("_ratio"))})
    return scanned.where("_side = 0").select("_row.*", F.coalesce(out, F.lit(1.0)).alias(out))


def spread_estimate(high: Column, low: Column) -> Column:
    """Spread proxy of one bar, NULL where a side is missing."""
    usable = (high > m.EPSILON) & (low > m.EPSILON)
    return F.when(usable, (high - low) / ((high + low) / 2) * 100.0)


def quoted_spread(bid: Column, ask: Column) -> Column:
    """Spread of a quote in percent of its middle, NULL where crossed or one-sided."""
    return F.when((bid > m.EPSILON) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 100.0)


def assess_tradability(bars: DataFrame, walls: tuple[str, ...],
                       rule_set: TradabilityRules) -> DataFrame:
    """Was there liquidity in the minutes after each reference time?"""
    start = F.col("reference_ts")
    inside = (F.col("minute") >= start) & (
        F.col("minute") < tg.plus_minutes(start, rule_set.window_minutes))
    figures = reference_times(bars, walls).groupBy(*DAY, "reference_ts").agg(
        F.sum(F.when(inside, F.col("close") * F.col("volume"))).alias("dollar_volume_in_window"),
        F.avg(F.when(inside, spread_estimate(F.col("high"), F.col("low")))).alias("_spread"),
    )
    tradeable, spread, source, reason = rules.tradability(
        F.col("dollar_volume_in_window"), F.col("_spread"), rule_set)
    return figures.select(
        *DAY, "reference_ts", "dollar_volume_in_window", spread.alias("est_spread_pct"),
        source.alias("spread_source"), tradeable.alias("tradeable"), reason.alias("reason"))
