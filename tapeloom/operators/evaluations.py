"""Reductions of stored evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.config import OutcomeRules, PillarThresholds
from tapeloom.functions import rules, text
from tapeloom.operators.scan import top_rows


#: Room for a time in microseconds below a tier's rank in one whole number.
_TIME_BITS = 57


def _rank_then_time(rank: Column, ts: Column) -> Column:
    """Smallest for the highest rank, the earliest time first; a long, so Spark folds it in a hash table."""
    top = len(rules.TIERS) - 1
    return F.shiftleft((F.lit(top) - F.coalesce(rank, F.lit(-1))).cast("long"), _TIME_BITS) + F.unix_micros(ts)


def _its_time(key: Column) -> Column:
    return F.timestamp_micros(key.bitwiseAND((1 << _TIME_BITS) - 1))


def best_tier(evaluations: DataFrame, by: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Highest tier per ticker-day and the first moment it was reached."""
    ranked = evaluations.withColumn("_rank", rules.tier_rank(F.col("tier")))
    top = ranked.groupBy(*by).agg(
        F.max("_rank").alias("_best"),
        _its_time(F.min(_rank_then_time(F.col("_rank"), F.col("poll_ts")))).alias("best_tier_ts"),
    )
    return top.withColumn("best_tier", rules.tier_name(F.col("_best"))).drop("_best")


def evaluation_summary(evaluations: DataFrame, th: PillarThresholds,
                       order: Sequence[str]) -> DataFrame:
    """Latest verdicts per ticker-day as an array, with the best tier: one aggregate."""
    fields = ["gap_pct", "rvol", "news_age", "price", "float_shares",
              *[f"p{i}" for i in range(1, 6)]]
    rank = F.col("_rank")
    latest = evaluations.withColumn("_rank", rules.tier_rank(F.col("tier"))).groupBy(
        "ticker", "date").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"),
        F.max(rank).alias("_best"),
        _its_time(F.min(_rank_then_time(rank, F.col("poll_ts")))).alias("best_tier_ts"),
    ).select("ticker", "date", "_row.*", rules.tier_name(F.col("_best")).alias("best_tier"),
             "best_tier_ts")
    values = {1: "gap_pct", 2: "rvol", 3: "news_age", 4: "price", 5: "float_shares"}
    limits = {1: th.gap_pct_min, 2: th.rvol_min, 3: th.news_fresh_minutes, 4: th.price_max,
              5: th.float_shares_max}
    pillars = F.array(*[
        F.struct(
            F.lit(n).alias("number"), F.lit(rules.PILLAR_NAMES[n]).alias("name"),
            F.col(f"p{n}").alias("status"), F.col(values[n]).cast("double").alias("value"),
            F.lit(float(limits[n])).alias("threshold"), F.lit("").alias("detail"),
        ) for n in range(1, 6)
    ])
    return latest.select(
        "ticker", "date", pillars.alias("pillars"), "float_shares",
        F.lit(True).alias("evaluated"), "best_tier", "best_tier_ts")


def bar_scope(evaluations: DataFrame, rule_set: OutcomeRules) -> DataFrame:
    """Ticker-days worth fetching bars for, with the largest gap seen."""
    wanted = F.coalesce(F.col("gap_pct") >= rule_set.session_change_min_pct, F.lit(False)) | \
        F.col("tier").isin(*rules.SIGNAL_TIERS)
    return evaluations.where(wanted).groupBy("date", "ticker").agg(
        F.max(F.greatest(F.coalesce("gap_pct", F.lit(0.0)), F.lit(0.0))).alias("change_pct"))


def split_scope(scope: DataFrame, max_tickers: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)`` per day: largest change first, ties by ticker."""
    kept = top_rows(scope, ["date"], [F.desc("change_pct"), F.asc("ticker")], max_tickers)
    skipped = scope.join(kept.select("date", "ticker"), ["date", "ticker"], "left_anti")
    return kept, skipped


def tier_counts(evaluations: DataFrame) -> DataFrame:
    """Evaluations per tier in every poll, zeros included."""
    return evaluations.groupBy("poll_ts").agg(
        *[F.count_if(F.col("tier") == name).alias(f"n_{name.lower()}") for name in rules.TIERS])


def alert_history(evaluations: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per alert id with its latest values; ``pushed`` never un-sets."""
    fired = evaluations.where(F.col("tier").isin("A", "B")).withColumn(
        "alert_id",
        text.alert_id(F.col("date"), F.col("window_start"), F.col("ticker"), F.col("tier")))
    keep = ["ticker", "date", "tier", "poll_ts", "window_start", "price", "gap_pct", "rvol"]
    return fired.groupBy("alert_id").agg(
        F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"),
        F.bool_or("pushed").alias("pushed"),
        F.min("poll_ts").alias("first_poll_ts"),
    ).select("alert_id", "_row.*", "pushed", "first_poll_ts")
