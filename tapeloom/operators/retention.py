"""What survives the night: movers, signals, a control sample, and a trace of the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import RetentionRules
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.operators.bars import DAY
from tapeloom.session import written_once

SUMMARY = (
    "ticker", "date", "up_move_pct", "down_move_pct", "max_runup_pct", "day_high", "day_low",
    "last_price", "session_volume", "max_gap_pct", "max_rvol", "poll_count", "first_poll_ts",
    "last_poll_ts",
)


def summaries_from_bars(moves: DataFrame, polls: DataFrame) -> DataFrame:
    """Ticker-day summary from bar metrics plus what polling saw."""
    seen = _poll_facts(polls)
    return moves.join(seen, list(DAY), "left").select(
        *DAY, "up_move_pct", "down_move_pct", "max_runup_pct", "day_high", "day_low",
        F.col("session_close").alias("last_price"), "session_volume", "max_gap_pct", "max_rvol",
        F.coalesce("poll_count", F.lit(0).cast("long")).alias("poll_count"), "first_poll_ts",
        "last_poll_ts")


def _poll_facts(polls: DataFrame) -> DataFrame:
    return polls.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("poll_count"),
        F.min("poll_ts").alias("first_poll_ts"),
        F.max("poll_ts").alias("last_poll_ts"),
        F.max("volume").alias("session_volume"),
        F.max("gap_pct").alias("max_gap_pct"),
        F.max("rvol").alias("max_rvol"),
    )


def summaries_from_snapshots(polls: DataFrame, prev_close: DataFrame) -> DataFrame:
    """The same summary from polled prices, for tickers without bars.

    ``polls`` needs ticker, date, poll_ts, price, volume, gap_pct and rvol.
    The running low covers the polls of one ticker-day, as many as the poll
    cadence allows.
    """
    so_far = W.partitionBy(*DAY).orderBy("poll_ts").rowsBetween(W.unboundedPreceding, 0)
    path = polls.withColumn("_low", F.min("price").over(so_far)).withColumn(
        "_run", F.when(F.col("_low") > 0, (F.col("price") / F.col("_low") - 1.0) * 100.0))
    priced = F.when(F.col("price").isNotNull(), F.col("poll_ts"))
    days = path.groupBy(*DAY).agg(
        F.max("price").alias("day_high"),
        F.min("price").alias("day_low"),
        F.max("_run").alias("max_runup_pct"),
        F.max_by("price", priced).alias("last_price"),
        F.max("volume").alias("session_volume"),
        F.max("gap_pct").alias("max_gap_pct"),
        F.max("rvol").alias("max_rvol"),
        F.count(F.lit(1)).alias("poll_count"),
        F.min("poll_ts").alias("first_poll_ts"),
        F.max("poll_ts").alias("last_poll_ts"),
    ).where(F.col("day_high").isNotNull())
    return days.join(prev_close.select(*DAY, "prev_close"), list(DAY), "left").select(
        *DAY,
        m.pct_change(F.col("day_high"), F.col("prev_close")).alias("up_move_pct"),
        m.pct_change(F.col("day_low"), F.col("prev_close")).alias("down_move_pct"),
        *SUMMARY[4:],
    )


def combine_summaries(from_bars: DataFrame, from_snapshots: DataFrame) -> DataFrame:
    """Bar metrics win; snapshot metrics only fill ticker-days without bars."""
    rest = from_snapshots.join(from_bars.select(*DAY), list(DAY), "left_anti")
    return from_bars.select(*SUMMARY).unionByName(rest.select(*SUMMARY))


def classify(summaries: DataFrame, best_tiers: DataFrame, rule_set: RetentionRules) -> DataFrame:
    """Add ``best_tier``, ``retention_class`` (NULL = drop) and ``reason``."""
    rows = summaries.join(best_tiers.select(*DAY, "best_tier"), list(DAY), "left").withColumn(
        "best_tier", F.coalesce("best_tier", F.lit("none")))
    mover = rules.is_mover(F.col("up_move_pct"), F.col("max_runup_pct"), F.col("down_move_pct"),
                           rule_set.move_threshold_pct)
    klass = rules.retention_class(mover, F.col("best_tier"), F.col("ticker"), F.col("date"),
                                  rule_set)
    return rows.withColumn("retention_class", klass).withColumn(
        "reason", rules.retention_reason(F.col("retention_class"), F.col("best_tier"), rule_set))


class Pruned(NamedTuple):
    snapshots: DataFrame
    summary: DataFrame
    report: DataFrame


def prune(snapshots: DataFrame, classified: DataFrame, rule_set: RetentionRules,
          store: bool = False) -> Pruned:
    """Keep, label and count.

    A ticker-day nobody classified is kept as a signal: a failed metrics job
    must not cost data that cannot be fetched again. Snapshots are counted per
    ticker-day before they meet the verdicts; with ``store`` that table is written
    once, for callers who use all three results.
    """
    counted = snapshots.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows"))
    verdicts = classified.withColumn("_known", F.lit(True))
    met = counted.join(verdicts, list(DAY), "left").withColumn(
        "klass", F.when(F.col("_known").isNull(), "signal").otherwise(F.col("retention_class")))
    present = written_once(met, "judged-days") if store else met
    is_kept = F.col("klass").isNotNull()
    report = present.groupBy("date").agg(
        F.sum("rows").alias("rows_before"),
        F.coalesce(F.sum(F.when(is_kept, F.col("rows"))), F.lit(0)).alias("rows_after"),
        *[F.count_if(F.col("klass") == k).alias(f"{k}_count")
          for k in ("mover", "signal", "control")],
        F.count_if(~is_kept).alias("dropped_count"),
    ).withColumn("move_threshold_pct", F.lit(rule_set.move_threshold_pct))
    labels = present.select(*DAY, F.struct(F.col("klass").alias("klass")).alias("_label"))
    kept = snapshots.drop("retention_class").join(labels, list(DAY), "left").withColumn(
        "retention_class", F.when(F.col("_label").isNull(), "signal").otherwise(F.col("_label.klass"))
    ).where(F.col("retention_class").isNotNull()).drop("_label")
    summary = present.where(~is_kept).select(*classified.columns)
    return Pruned(kept, pruned_rows(summary), report)


def pruned_rows(dropped: DataFrame) -> DataFrame:
    """One row per dropped ticker-day, so the denominator stays known."""
    return dropped.select(
        *DAY, F.col("poll_count").cast("int").alias("poll_count"),
        F.col("first_poll_ts").alias("first_poll_ts_utc"),
        F.col("last_poll_ts").alias("last_poll_ts_utc"),
        F.col("day_high").alias("session_high"), F.col("day_low").alias("session_low"),
        "last_price", "session_volume", "max_gap_pct", "max_rvol", "up_move_pct",
        "down_move_pct", "best_tier", F.col("reason").alias("drop_reason"))


def due_for_thinning(day: Column, today: Column, resolution: Column,
                     rule_set: RetentionRules) -> Column:
    return (F.datediff(today, day) > rule_set.bars_raw_days) & (resolution == 1)


def snapshot_cutoff(today: Column, rule_set: RetentionRules) -> Column:
    return F.date_sub(today, int(rule_set.snapshots_months * 30.44))
