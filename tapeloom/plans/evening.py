"""Evening job: bars to daily universe, outcomes, runners and summaries.

Bars are read once from the lake and feed four branches; every branch groups by
ticker and day, so one layout serves them all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import (
    SESSIONS,
    IntegrityRules,
    OutcomeRules,
    PillarThresholds,
    RunnerRules,
    TradabilityRules,
    Window,
)
from tapeloom.functions import rules
from tapeloom.operators import bars as bar_ops
from tapeloom.operators import evaluations as ev
from tapeloom.operators import integrity, outcomes, runners
from tapeloom.operators.bars import DAY
from tapeloom.session import written_once
from tapeloom.sources import lake


@dataclass(frozen=True)
class EveningRules:
    """``halt_sessions`` bounds the silences that count as halts; None takes the whole day."""

    outcomes: OutcomeRules = field(default_factory=OutcomeRules)
    tradability: TradabilityRules = field(default_factory=TradabilityRules)
    runners: RunnerRules = field(default_factory=RunnerRules)
    integrity: IntegrityRules = field(default_factory=IntegrityRules)
    thresholds: PillarThresholds = field(default_factory=PillarThresholds)
    bar_minutes: int = 1
    surge_volume: float = float("inf")
    halt_sessions: Mapping[str, Window] | None = field(
        default_factory=lambda: {"regular": SESSIONS["regular"]})


def lake_bars(spark: SparkSession, root: str, days: Sequence[date]) -> DataFrame:
    """The days' bars as the operators name them."""
    return lake.read_days(spark, root, "bars_1m", days).withColumnRenamed("minute_utc", "minute").select(
        *DAY, "minute", "open", "high", "low", "close", "volume", "vwap", "trade_count")


def universe_rows(bars: DataFrame, halts: DataFrame, prev_closes: DataFrame, actions: DataFrame,
                  rule_set: EveningRules, now: Column) -> DataFrame:
    """Three rows per ticker-day with the day's integrity flags."""
    dense = bar_ops.dense_rollup(bars)
    days = dense.groupBy(*DAY).agg(
        F.max_by("close", F.when(F.col("session") == "regular", 1)).alias("_close"),
        F.sum("volume").alias("_day_volume"))
    facts = integrity.days_since_reverse_split(days, actions)
    facts = integrity.action_on(facts, actions)
    facts = facts.join(integrity.halt_summary(halts), list(DAY), "left").join(
        prev_closes.select(*DAY, "prev_close"), list(DAY), "left")
    split = F.coalesce(rules.is_split(F.col("action_type")), F.lit(False))
    flags = facts.select(
        *DAY, "prev_close", split.alias("split_flag"),
        F.when(split, F.col("ratio")).alias("split_ratio"),
        F.col("days_since_reverse_split").cast("int").alias("days_since_reverse_split"),
        F.coalesce("halt_count", F.lit(0)).cast("int").alias("halt_count"),
        F.coalesce("halt_minutes", F.lit(0.0)).alias("halt_minutes"),
        rules.suspect_price(
            F.col("_close"), F.col("prev_close"), rule_set.integrity.suspect_price_change,
            F.col("_day_volume") >= rule_set.surge_volume,
            F.col("action_type").isNotNull()).alias("suspect_price"))
    return dense.drop("bar_count").join(flags, list(DAY)).withColumns({
        "ticker_canonical_id": F.col("ticker"), "written_at_utc": now})


def run_evening(spark: SparkSession, root: str, days: Sequence[date], prev_closes: DataFrame,
                actions: DataFrame, summaries: DataFrame, first_news: DataFrame,
                rule_set: EveningRules, now: Column) -> None:
    """Write ``daily_universe``, ``outcomes`` and ``runners`` of the given days from the lake's bars.

    ``summaries`` is ``evaluations.evaluation_summary``. The days then hold
    exactly what this run found, nothing if it found nothing; other days are
    neither read nor touched.
    """
    bars = lake_bars(spark, root, days)
    prev_closes = prev_closes.where(F.col("date").isin(list(days)))
    silent, minutes = rule_set.integrity.halt_min_silent_minutes, rule_set.bar_minutes
    halts = integrity.infer_halts(bars, silent, minutes, rule_set.halt_sessions)
    on_basis = written_once(integrity.action_on(prev_closes.select(*DAY, "prev_close"), actions).select(
        *DAY, integrity.adjusted_close(
            F.col("prev_close"), F.col("action_type"), F.col("ratio")).alias("prev_close")), "closes")
    lake.set_days(
        universe_rows(bars, halts, on_basis, actions, rule_set, now), root, "daily_universe", days, "bars")
    labels = outcomes.outcomes(
        integrity.with_gaps(bars, silent, minutes, rule_set.halt_sessions), rule_set.outcomes, rule_set.tradability,
        on_basis, now)
    lake.set_days(labels.withColumn("written_at_utc", now), root, "outcomes", days, "bars")
    found = runners.diagnose(
        runners.detect(bars, on_basis, rule_set.runners), summaries, first_news, rule_set.runners)
    lake.set_days(runners.runner_rows(found, now), root, "runners", days, "bars")


def scope(evaluations: DataFrame, rule_set: OutcomeRules) -> tuple[DataFrame, DataFrame]:
    """Ticker-days to fetch bars for, and the ones deferred by the cap."""
    return ev.split_scope(ev.bar_scope(evaluations, rule_set), rule_set.max_bar_tickers)
