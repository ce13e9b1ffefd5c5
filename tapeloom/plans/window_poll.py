"""One alert-window evaluation: snapshots in, judged and ranked rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.config import (
    ALERT_WINDOWS,
    FALLBACK_SESSION_FRACTION,
    IntegrityRules,
    PillarThresholds,
    PushRules,
    RankWeights,
    Window,
)
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators import collect, push
from tapeloom.operators import news as news_ops
from tapeloom.operators.scan import percentile_ranks
from tapeloom.session import written_once


@dataclass(frozen=True)
class PollContext:
    """Everything a poll is judged by that is not in the snapshot."""

    thresholds: PillarThresholds = field(default_factory=PillarThresholds)
    weights: RankWeights = field(default_factory=RankWeights)
    push_rules: PushRules = field(default_factory=PushRules)
    integrity: IntegrityRules = field(default_factory=IntegrityRules)
    windows: Sequence[Window] = ALERT_WINDOWS
    session_fraction: float = FALLBACK_SESSION_FRACTION
    received_too: bool = False


def judge_polls(
    polls: DataFrame,
    context: PollContext,
    tagged_news: DataFrame,
    prev_closes: DataFrame | None = None,
    baselines: DataFrame | None = None,
    recent_runners: DataFrame | None = None,
    feed_healthy: Column | None = None,
) -> DataFrame:
    """Metrics, five verdicts and the tier of every poll row inside a window.

    ``polls`` carries ticker, poll_ts, price, volume, change_pct,
    average_volume_10d and float_shares; ``prev_closes`` is keyed by ticker and
    date, ``baselines`` by ticker, date and minute offset, ``recent_runners``
    is a list of tickers. Polls that come with ``open_price`` and ``open_volume``,
    what a ticker had when first seen in its window, are measured against those.
    """
    c = F.col
    rows = polls.withColumns({
        "window_start": tg.window_start(c("poll_ts"), context.windows),
        "date": tg.et_date(c("poll_ts")),
    }).where(c("window_start").isNotNull())
    known = {"open_price", "open_volume"} <= set(polls.columns)
    rows = collect.moves_from(rows) if known else collect.with_window_moves(rows)
    if prev_closes is not None:
        rows = rows.join(prev_closes.select("ticker", "date", "prev_close"),
                         ["ticker", "date"], "left")
    else:
        rows = rows.withColumn("prev_close", F.lit(None).cast("double"))
    if baselines is not None:
        rows = rows.withColumn("minute_offset", tg.minute_offset(c("poll_ts"))).join(
            baselines.select("ticker", "date", "minute_offset", "baseline_volume"),
            ["ticker", "date", "minute_offset"], "left")
    else:
        rows = rows.withColumn("baseline_volume", F.lit(None).cast("double"))
    volume = F.coalesce(c("volume"), F.lit(0.0))
    rvol, source = m.resolve_rvol(
        volume, c("baseline_volume"), c("average_volume_10d"), context.session_fraction)
    rows = rows.withColumns({
        "gap_pct": m.gap_pct(c("price"), c("prev_close"), c("change_pct")),
        "rvol": rvol,
        "rvol_source": source,
        "confidence": m.float_confidence(
            c("float_shares"), m.float_turnover(volume, c("float_shares")),
            F.lit(None).cast("timestamp"), c("poll_ts"),
            context.integrity.float_turnover_low_confidence,
            context.integrity.float_asof_max_age_days),
    })
    rows = news_ops.latest_news(rows, tagged_news, "poll_ts", received_too=context.received_too)
    rows = news_ops.fresh_only(news_ops.with_freshness(
        rows, "poll_ts", context.thresholds.news_fresh_minutes))
    if recent_runners is not None:
        recent = recent_runners.select("ticker").distinct().withColumn("_recent", F.lit(True))
        rows = rows.join(recent, "ticker", "left").withColumn(
            "is_recent_runner", F.coalesce("_recent", F.lit(False))).drop("_recent")
    else:
        rows = rows.withColumn("is_recent_runner", F.lit(False))
    rows = rows.withColumn("pillars", rules.pillar_structs(
        c("gap_pct"), c("rvol"), c("news_age"), c("price"), c("float_shares"), c("confidence"),
        context.thresholds, feed_healthy, c("news.headline")))
    rows = rows.withColumns({f"p{n}": c("pillars")[n - 1]["status"] for n in range(1, 6)})
    statuses = [c(f"p{n}") for n in range(1, 6)]
    return rows.withColumns({
        "passed": rules.status_count(statuses, "pass"),
        "unknown": rules.status_count(statuses, "unknown"),
        "tier": rules.tier(statuses, c("is_recent_runner")),
    })


def rank_polls(judged: DataFrame, context: PollContext) -> DataFrame:
    """Composite rank across each poll.

    Ranks read their input several times, a few columns each, so both this and
    what follows start from a written table. Of the verdicts and the article it
    holds what :func:`evaluation_rows` tells of them, no texts and no structs.
    """
    c = F.col
    judged = written_once(judged.withColumns({
        "news_value": c("pillars")[2]["value"], "news_id": c("news.news_id")}).drop("pillars", "news"), "judged-polls")
    ranked = percentile_ranks(judged, ["poll_ts"], {
        "window_change_pct": "_r_change", "rvol": "_r_rvol", "gap_pct": "_r_gap"})
    scored = ranked.withColumn("rank_score", m.rank_score(
        F.col("_r_change"), F.col("_r_rvol"), F.col("_r_gap"), context.weights)).drop(
        "_r_change", "_r_rvol", "_r_gap")
    return written_once(scored, "ranked-polls")


def rank_and_push(judged: DataFrame, context: PollContext) -> DataFrame:
    """Composite rank across each poll, then the push decision per window."""
    return push.decide_pushes(rank_polls(judged, context), context.push_rules)


def evaluate_polls(polls: DataFrame, context: PollContext, tagged_news: DataFrame,
                   **facts) -> DataFrame:
    """The whole chain; see :func:`judge_polls` for the optional facts."""
    return rank_and_push(judge_polls(polls, context, tagged_news, **facts), context)


def evaluation_rows(evaluated: DataFrame, now: Column) -> DataFrame:
    """Rows of the ``evaluations`` table: every verdict, alerting or not."""
    c = F.col
    return evaluated.select(
        "ticker", "date", c("poll_ts").alias("poll_ts_utc"),
        c("window_start").alias("window_start_utc"), "price", "gap_pct", "window_change_pct",
        "rvol", "rvol_source", c("float_shares").cast("long").alias("float_shares"),
        c("confidence").alias("float_confidence"),
        c("news_value").alias("news_age_minutes"), "news_id",
        *[c(f"p{n}").alias(f"pillar_{n}_status") for n in range(1, 6)],
        c("passed").cast("int").alias("pillars_passed"),
        c("unknown").cast("int").alias("pillars_unknown"),
        "tier", "rank_score", "is_recent_runner", "pushed", "push_reason",
        now.alias("written_at_utc"))
