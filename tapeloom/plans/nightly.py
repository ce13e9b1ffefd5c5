"""Closing job: prune, compact, age out, account."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.config import RetentionRules
from tapeloom.operators import bars as bar_ops
from tapeloom.operators import quality
from tapeloom.operators import retention as rt
from tapeloom.session import written_once
from tapeloom.sources import lake

COMPACTED = ("snapshots", "evaluations", "reference", "bars_1m", "outcomes", "news")


class NightlyDone(NamedTuple):
    prune_report: DataFrame
    compacted: DataFrame
    thinned: DataFrame
    dropped: DataFrame
    quality: DataFrame
    warnings: DataFrame
    size_warning: DataFrame


def prune_snapshots(spark: SparkSession, root: str, days: Sequence[date], classified: DataFrame,
                    rules: RetentionRules, now: Column) -> DataFrame:
    """Rewrite the snapshots of the given days, leaving a summary row per dropped ticker.

    Other days are neither read nor touched: their labels were set by their own
    nights and cannot be recomputed from pruned rows.
    """
    snapshots = lake.read_days(spark, root, "snapshots", days)
    done = rt.prune(snapshots, classified.where(F.col("date").isin(list(days))), rules, store=True)
    report = written_once(done.report, "prune-report")
    dropped = written_once(done.summary.withColumn("written_at_utc", now), "pruned-summary")
    lake.set_days(dropped, root, "pruned_summary", days, "nightly")
    lake.rewrite_days(done.snapshots, root, "snapshots", days, "nightly")
    return report


def thin_old_bars(spark: SparkSession, root: str, today: Column, rules: RetentionRules,
                  raw_minutes: int = 1) -> DataFrame:
    """Re-bucket days past the raw horizon; returns rows before and after."""
    bars = lake.read_table(spark, root, "bars_1m")
    due = (F.datediff(today, F.col("date")) > rules.bars_raw_days) & (
        F.col("resolution_minutes") == raw_minutes)
    # one row a day: the days past the horizon that still hold raw bars
    old_days = sorted(r["date"] for r in bars.where(due).select("date").distinct().toLocalIterator())
    old = lake.read_days(spark, root, "bars_1m", old_days)
    before = written_once(old.groupBy("date").agg(F.count(F.lit(1)).alias("rows_before")), "thin")
    last = old.groupBy(
        "ticker", "date",
        bar_ops.tg.floor_minutes(F.col("minute_utc"), rules.bars_thinned_minutes).alias("minute")
    ).agg(F.max_by(F.struct("written_at_utc", "source"), "minute_utc").alias("_last"))
    thin = bar_ops.thin_bars(
        old.withColumnRenamed("minute_utc", "minute"), rules.bars_thinned_minutes)
    rows = thin.join(last, ["ticker", "date", "minute"]).select(
        "ticker", "date", F.col("minute").alias("minute_utc"), "open", "high", "low", "close",
        "volume", "trade_count", "vwap", "resolution_minutes", "_last.written_at_utc",
        "_last.source")
    lake.rewrite_days(rows, root, "bars_1m", old_days, "nightly")
    after = lake.row_counts(spark, root, "bars_1m").where(F.col("date").isin(old_days)).withColumnRenamed(
        "rows", "rows_after")
    return before.join(after, "date").withColumn(
        "action", F.lit(f"thinned to {rules.bars_thinned_minutes}m"))


class DayFacts(NamedTuple):
    """What the lake does not hold: ``quality.poll_coverage`` and ``failed_requests``, and the actions."""

    coverage: DataFrame | None = None
    failures: DataFrame | None = None
    actions: DataFrame | None = None


#: Cells of a snapshot counted as missing where NULL.
NEEDED = ("price", "session_volume", "gap_pct", "rvol")


def quality_rows(spark: SparkSession, root: str, days: Sequence[date], prune_report: DataFrame,
                 outage_minutes: DataFrame | None = None, facts: DayFacts = DayFacts()) -> DataFrame:
    """One row per table and given day from what the lake holds now.

    Halts come from the day's universe, which the evening job wrote. Missing
    fields and suspect prices are those of the rows pruning kept.
    """
    def of(table: str) -> DataFrame:
        return lake.read_days(spark, root, table, days)

    evaluations = of("evaluations").withColumnRenamed("float_confidence", "confidence")
    suspects = of("snapshots").groupBy("date").agg(
        F.count_if(F.coalesce("suspect_price", F.lit(False))).alias("suspect_price_rows"))
    # three rows per ticker-day carry the same halts
    halts = of("daily_universe").groupBy("ticker", "date").agg(F.max("halt_count").alias("halt_count"))
    applied = None if facts.actions is None else quality.action_counts(
        facts.actions.where(F.col("effective_date").isin(list(days))))
    return quality.union_rows(
        quality.evaluation_quality(evaluations, applied),
        quality.outcome_quality(of("outcomes"), halts, applied),
        quality.news_quality(of("news"), outage_minutes),
        quality.snapshot_quality(prune_report, suspects, facts.coverage,
                                 quality.missing_fields(of("snapshots"), NEEDED), facts.failures),
    )


def run_nightly(spark: SparkSession, root: str, days: Sequence[date], classified: DataFrame,
                rules: RetentionRules, today: Column, now: Column, outage_minutes: DataFrame | None = None,
                raw_minutes: int = 1, facts: DayFacts = DayFacts()) -> NightlyDone:
    """All closing steps for the given days; ``classified`` comes from ``retention.classify``."""
    report = prune_snapshots(spark, root, days, classified, rules, now)
    compacted = None
    for table in COMPACTED:
        one = lake.compact(spark, root, table).withColumn("table_name", F.lit(table))
        compacted = one if compacted is None else compacted.unionByName(one)
    thinned = thin_old_bars(spark, root, today, rules, raw_minutes)
    dropped = lake.drop_days(spark, root, "snapshots", rt.snapshot_cutoff(today, rules))
    rows = written_once(quality_rows(spark, root, days, report, outage_minutes, facts), "quality")
    ints = [c for c in quality.COUNTERS if c != "missing_field_count"]
    lake.set_days(
        rows.withColumns({c: F.col(c).cast("int") for c in [*ints, "polls_expected",
                                                           "polls_completed"]})
        .withColumn("written_at_utc", now), root, "data_quality", days, "nightly")
    sizes = lake.coverage(spark, root)
    return NightlyDone(report, compacted, thinned, dropped, rows, quality.warnings(rows),
                       lake.size_warning(sizes, rules))
