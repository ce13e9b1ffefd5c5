"""Loose collection: which snapshot rows enter the lake, and what they carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.config import FALLBACK_SESSION_FRACTION, CollectionRules, IntegrityRules, Window
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators.integrity import action_on, quoted_spread, state_at
from tapeloom.operators.scan import running, top_rows

#: Slow fields whose change makes a new reference row. Market
#: value is left out on purpose, it moves with every tick.
COMPARED_FIELDS = (
    "sector",
    "industry",
    "float_shares_outstanding",
    "total_shares_outstanding",
    "average_volume_10d_calc",
    "average_volume_30d_calc",
    "float_source",
    "float_asof",
    "float_confidence",
)


def top_dollar_volume(polls: DataFrame, n: int) -> DataFrame:
    """``(poll_ts, ticker)`` of the ``n`` busiest tickers per poll."""
    traded = polls.where(F.col("price").isNotNull() & F.col("volume").isNotNull())
    value = m.dollar_volume(F.col("price"), F.col("volume"))
    return top_rows(
        traded.select("poll_ts", "ticker", value.alias("dollar_volume")),
        ["poll_ts"], [F.desc("dollar_volume"), F.asc("ticker")], n,
    )


def label_rules(
    polls: DataFrame, rule_set: CollectionRules,
    fraction: float = FALLBACK_SESSION_FRACTION,
) -> DataFrame:
    """Add ``rule`` and ``collected`` to every snapshot row."""
    top = top_dollar_volume(polls, rule_set.top_dollar_volume_n).select(
        "poll_ts", "ticker", F.lit(True).alias("_top"))
    flagged = polls.join(top, ["poll_ts", "ticker"], "left")
    rule = rules.collection_rule(
        F.col("price"), F.col("change_pct"), F.col("volume"), F.col("average_volume_10d"),
        F.coalesce("_top", F.lit(False)), rule_set, fraction,
    )
    return flagged.withColumn("rule", rule).withColumn(
        "collected", F.col("rule").isin(*rules.COLLECTED_RULES)).drop("_top")


def window_baselines(polls: DataFrame, window: str = "window_start") -> DataFrame:
    """First observed price and volume per ticker and window, combined map-side."""
    first = polls.groupBy(window, "ticker").agg(
        F.min_by(F.struct("price", "volume"), "poll_ts").alias("_first"),
        F.min("poll_ts").alias("opened_at"),
    )
    return first.select(
        window, "ticker", "opened_at",
        F.col("_first.price").alias("open_price"), F.col("_first.volume").alias("open_volume"),
    )


def with_window_moves(polls: DataFrame, window: str = "window_start") -> DataFrame:
    """Move and volume since the ticker was first seen in its window."""
    base = window_baselines(polls, window)
    return moves_from(polls.join(base, [window, "ticker"], "left"))


def moves_from(polls: DataFrame) -> DataFrame:
    """Move and volume since ``open_price`` and ``open_volume``."""
    return polls.withColumns({
        "window_change_pct": m.pct_change(F.col("price"), F.col("open_price")),
        "window_volume": m.window_volume(F.col("volume"), F.col("open_volume")),
    })


def change_only(
    observations: DataFrame,
    keys: Sequence[str],
    at: str,
    fields: Sequence[str],
    ties: Sequence[str] = (),
    chunk_unit: str = "hour",
) -> DataFrame:
    """Rows that are the first of their key or differ from the one before.

    NULL equals NULL here. The look-back is a chunked scan, so one busy key
    does not end up on one task.
    """
    seen = running(
        observations.withColumn("_now", F.struct(*fields)),
        keys, F.date_trunc(chunk_unit, F.col(at)), [at, *ties],
        {"_before": ("last", F.col("_now"))}, include_current=False,
    )
    changed = ~F.col("_before").eqNullSafe(F.col("_now"))
    return seen.where(F.col("_before").isNull() | changed).drop("_now", "_before")


class Collected(NamedTuple):
    snapshots: DataFrame
    reference: DataFrame
    stats: DataFrame


def collect_polls(
    polls: DataFrame,
    rule_set: CollectionRules,
    integrity: IntegrityRules,
    window: Column,
    prev_closes: DataFrame | None = None,
    fraction: float = FALLBACK_SESSION_FRACTION,
    bars: DataFrame | None = None,
    actions: DataFrame | None = None,
    bar_minutes: int = 1,
    sessions: Mapping[str, Window] | None = None,
) -> Collected:
    """Snapshots, change-only reference rows and per-poll counts.

    ``polls`` carries ticker, poll_ts, price, volume, change_pct,
    average_volume_10d, float_shares and, where known, sector, industry,
    shares_outstanding, average_volume_30d, market_cap, bid and ask.

    ``bars`` of the days give the halt state known at each poll and a spread
    where no quote does (:func:`integrity.state_at`); without them both are
    NULL. A price is suspect if it is far from ``prev_closes`` and neither the
    volume that would have it collected nor one of ``actions`` on that day
    explains it; without a previous close it never is.
    """
    labelled = label_rules(polls, rule_set, fraction)
    kept = labelled.where("collected").withColumns(
        {"window_start": window, "date": tg.et_date(F.col("poll_ts"))})
    if prev_closes is not None:
        kept = kept.join(prev_closes.select("ticker", "date", "prev_close"),
                         ["ticker", "date"], "left")
    else:
        kept = kept.withColumn("prev_close", F.lit(None).cast("double"))
    have = set(polls.columns)
    if bars is not None:
        kept = state_at(kept, bars, integrity.halt_min_silent_minutes, bar_minutes,
                        sessions=sessions)
    else:
        unset = {"halt_status": "string", "inferred_halt": "boolean", "bar_spread_pct": "double"}
        kept = kept.withColumns({c: F.lit(None).cast(kind) for c, kind in unset.items()})
    if actions is not None:
        kept = action_on(kept, actions).withColumn(
            "on_record", F.col("action_type").isNotNull()).drop("action_type", "ratio")
    else:
        kept = kept.withColumn("on_record", F.lit(False))
    kept = kept.withColumns({
        side: (F.col(side) if side in have else F.lit(None)).cast("double") for side in ("bid", "ask")})
    quoted = quoted_spread(F.col("bid"), F.col("ask"))
    rvol = m.rvol_fallback(F.col("volume"), F.col("average_volume_10d"), fraction)
    moved = with_window_moves(kept)
    turnover = m.float_turnover(F.coalesce(F.col("volume"), F.lit(0.0)), F.col("float_shares"))
    snapshots = moved.select(
        "ticker", "date", F.col("poll_ts").alias("poll_ts_utc"), "price",
        F.col("volume").alias("session_volume"),
        m.gap_pct(F.col("price"), F.col("prev_close"), F.col("change_pct")).alias("gap_pct"),
        "window_change_pct", "window_volume",
        rvol.alias("rvol"),
        F.when(F.col("average_volume_10d") > m.EPSILON, "fallback").otherwise("unknown")
        .alias("rvol_source"),
        m.dollar_volume(F.col("price"), F.col("volume")).alias("dollar_volume"),
        "bid", "ask", F.coalesce(quoted, "bar_spread_pct").alias("spread_pct"),
        F.when(quoted.isNotNull(), "quoted").when(F.col("bar_spread_pct").isNotNull(), "estimated")
        .otherwise("unavailable").alias("spread_source"),
        "halt_status", "inferred_halt",
        rules.suspect_price(
            F.col("price"), F.col("prev_close"), integrity.suspect_price_change,
            F.coalesce(rvol >= rule_set.min_volume_ratio, F.lit(False)), F.col("on_record"),
        ).alias("suspect_price"),
        F.col("poll_ts").alias("written_at_utc"),
    )

    def slow(name: str, kind: str, source: str | None = None) -> Column:
        source = source or name
        col = F.col(source) if source in have else F.lit(None)
        return col.cast(kind).alias(name)

    observed = kept.select(
        "ticker", "date", F.col("poll_ts").alias("asof_ts_utc"),
        slow("sector", "string"), slow("industry", "string"),
        slow("float_shares_outstanding", "long", "float_shares"),
        slow("total_shares_outstanding", "long", "shares_outstanding"),
        slow("average_volume_10d_calc", "double", "average_volume_10d"),
        slow("average_volume_30d_calc", "double", "average_volume_30d"),
        slow("market_cap", "double"),
        F.lit("scanner").alias("float_source"),
        F.lit(None).cast("timestamp").alias("float_asof"),
        m.float_confidence(
            F.col("float_shares"), turnover, F.lit(None).cast("timestamp"), F.col("poll_ts"),
            integrity.float_turnover_low_confidence, 0).alias("float_confidence"),
        turnover.alias("float_turnover"),
        F.col("poll_ts").alias("written_at_utc"),
    )
    reference = change_only(observed, ["ticker", "date"], "asof_ts_utc", COMPARED_FIELDS)
    return Collected(snapshots, reference, collection_stats(labelled))


def collection_stats(labelled: DataFrame) -> DataFrame:
    """Rows considered and collected per poll, and how many each rule took."""
    named = ("below_price_floor", *rules.COLLECTED_RULES, "no_rule_matched")
    return labelled.groupBy("poll_ts").agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if("collected").alias("collected"),
        *[F.count_if(F.col("rule") == name).alias(name) for name in named],
    )
