"""Nightly data-quality rows and the warnings they raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import LATENCY_P95_WARN_S, Window
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators.calendar import poll_slot
from tapeloom.operators.scan import quantiles

#: Counters of a quality row, zero when a table has none.
COUNTERS = (
    "missing_field_count",
    "api_errors",
    "suspect_price_rows",
    "corporate_actions_applied",
    "rvol_baselines_recomputed",
    "halt_count",
    "inferred_halt_count",
    "mover_count",
    "control_count",
    "dropped_count",
)
MEASURES = (
    "polls_expected",
    "polls_completed",
    "pillar5_low_confidence_share",
    "news_latency_median_s",
    "news_latency_p95_s",
    "tradeable_share",
    "move_threshold_pct",
)


def share(part: Column, whole: Column) -> Column:
    """A ratio, NULL where there is nothing to divide by."""
    return F.try_divide(part, whole)


def quality_row(name: str, counts: DataFrame, columns: Mapping[str, Column] | None = None,
                note: Column | None = None) -> DataFrame:
    """Shape per-day figures of one table into quality rows.

    ``counts`` has ``date`` and ``rows_collected``; ``columns`` names what else
    it can supply.
    """
    columns = dict(columns or {})
    out = [F.col("date"), F.lit(name).alias("table_name"), F.col("rows_collected")]
    for c in COUNTERS:
        out.append(F.coalesce(columns.get(c, F.lit(0)).cast("long"), F.lit(0)).alias(c))
    minutes = columns.get("ws_disconnect_minutes", F.lit(0.0))
    out.append(F.coalesce(minutes.cast("double"), F.lit(0.0)).alias("ws_disconnect_minutes"))
    for c in MEASURES:
        kind = "long" if c.startswith("polls") else "double"
        out.append(columns.get(c, F.lit(None)).cast(kind).alias(c))
    empty = F.lit(None).cast("string")
    out.append((empty if note is None else F.nullif(note, F.lit(""))).alias("note"))
    return counts.select(*out)


def poll_coverage(expected: DataFrame, polls: DataFrame, windows: Sequence[Window],
                  cadence_minutes: int, late_after_minutes: float,
                  at: str = "poll_ts") -> DataFrame:
    """Per day: polls expected, completed, missed and late, and the longest gap.

    ``expected`` comes from :func:`calendar.expected_polls` over the same windows
    and cadence. A slot is completed by any poll inside it, and late if the first
    came more than ``late_after_minutes`` after it was due. The gap is the
    longest run of missed slots of a day, in minutes. Polls outside the windows,
    or on days without a session, complete nothing. Polls are folded to slots
    before they meet the grid; the run's window holds the slots of one day.
    """
    slot = poll_slot(F.col(at), windows, cadence_minutes)
    seen = polls.select(slot.alias("slot"), F.col(at).alias("_at")).where(
        F.col("slot").isNotNull()).groupBy("slot").agg(F.min("_at").alias("_first"))
    in_order = W.partitionBy("date").orderBy("slot")
    grid = expected.join(seen, "slot", "left").withColumn("_n", F.row_number().over(in_order))
    answered = F.max(F.when(F.col("_first").isNotNull(), F.col("_n"))).over(
        in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = grid.withColumn("_run", F.col("_n") - F.coalesce(answered, F.lit(0)))
    return runs.groupBy("date").agg(
        F.count(F.lit(1)).alias("polls_expected"),
        F.count("_first").alias("polls_completed"),
        F.count_if(F.col("_first").isNull()).alias("polls_missed"),
        F.count_if(tg.minutes_between(F.col("slot"), F.col("_first")) > late_after_minutes)
        .alias("polls_late"),
        (F.max("_run") * float(cadence_minutes)).alias("longest_gap_minutes"),
    )


def missing_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(date, missing_field_count)``: NULL cells among ``fields``."""
    empty = sum((F.col(c).isNull().cast("long") for c in fields), F.lit(0).cast("long"))
    return rows.groupBy("date").agg(F.sum(empty).alias("missing_field_count"))


def failed_requests(log: DataFrame, failed: Column, at: str = "ts") -> DataFrame:
    """``(date, api_errors)``: requests of a market day that failed."""
    return log.where(failed).groupBy(tg.et_date(F.col(at)).alias("date")).agg(
        F.count(F.lit(1)).alias("api_errors"))


def action_counts(actions: DataFrame) -> DataFrame:
    """Per effective day: actions applied, and tickers whose volume baseline a split makes anew."""
    split = rules.is_split(F.col("action_type"))
    per_ticker = actions.groupBy(F.col("effective_date").alias("date"), "ticker").agg(
        F.count(F.lit(1)).alias("_actions"), F.max(split.cast("int")).alias("_split"))
    return per_ticker.groupBy("date").agg(
        F.sum("_actions").alias("corporate_actions_applied"),
        F.sum("_split").alias("rvol_baselines_recomputed"))


def with_facts(counts: DataFrame, columns: dict[str, Column],
               *facts: tuple[DataFrame | None, Sequence[str]]) -> tuple[DataFrame, dict[str, Column]]:
    """Join per-day figures, one row a day, to the counts of a table; absent ones are left out."""
    for days, names in facts:
        if days is not None:
            counts = counts.join(days.select("date", *names), "date", "left")
            columns = columns | {c: F.col(c) for c in names}
    return counts, columns


def evaluation_quality(evaluations: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """``applied`` is :func:`action_counts`: splits cost baselines."""
    counts = evaluations.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows_collected"),
        F.count_if(F.col("confidence") == "low").alias("_low"))
    low = {"pillar5_low_confidence_share": share(F.col("_low"), F.col("rows_collected"))}
    return quality_row("evaluations", *with_facts(counts, low, (applied, ["rvol_baselines_recomputed"])))


def outcome_quality(outcomes: DataFrame, halts: DataFrame | None = None,
                    applied: DataFrame | None = None) -> DataFrame:
    """``applied`` is :func:`action_counts`: actions move the closes that outcomes start from."""
    counts = outcomes.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows_collected"), F.count_if("tradeable").alias("_ok"))
    extra = {"tradeable_share": share(F.col("_ok"), F.col("rows_collected"))}
    if halts is not None:
        per_day = halts.groupBy("date").agg(
            F.sum("halt_count").alias("_halts"))
        counts = counts.join(per_day, "date", "left")
        extra |= {"halt_count": F.col("_halts"), "inferred_halt_count": F.col("_halts")}
    return quality_row("outcomes", *with_facts(counts, extra, (applied, ["corporate_actions_applied"])))


def news_quality(news: DataFrame, outage_minutes: DataFrame | None = None) -> DataFrame:
    """Latency percentiles are exact and nearest-rank; the median interpolates."""
    counts = news.groupBy("date").agg(F.count(F.lit(1)).alias("rows_collected"))
    marks = quantiles(news, ["date"], "feed_latency_s", {"_p95": 0.95}, {"_median": 0.5})
    counts = counts.join(marks, "date", "left")
    extra = {"news_latency_p95_s": F.col("_p95"), "news_latency_median_s": F.col("_median")}
    if outage_minutes is not None:
        counts = counts.join(outage_minutes.select("date", "disconnect_minutes"), "date", "left")
        extra["ws_disconnect_minutes"] = F.col("disconnect_minutes")
    return quality_row("news", counts, extra)


def snapshot_quality(report: DataFrame, suspects: DataFrame | None = None,
                     coverage: DataFrame | None = None, missing: DataFrame | None = None,
                     failures: DataFrame | None = None) -> DataFrame:
    """From a prune report; ``suspects`` is ``(date, suspect_price_rows)``.

    ``coverage``, ``missing`` and ``failures`` come from :func:`poll_coverage`,
    :func:`missing_fields` and :func:`failed_requests`.
    """
    counts = report.withColumn("rows_collected", F.col("rows_after"))
    names = ["mover_count", "control_count", "dropped_count", "move_threshold_pct"]
    return quality_row("snapshots", *with_facts(
        counts, {c: F.col(c) for c in names}, (suspects, ["suspect_price_rows"]),
        (coverage, ["polls_expected", "polls_completed"]), (missing, ["missing_field_count"]),
        (failures, ["api_errors"])))


def union_rows(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def warnings(rows: DataFrame, latency_warn_s: float = LATENCY_P95_WARN_S) -> DataFrame:
    """``(date, table_name, code, value)``: one row per condition worth showing, with its figure."""
    low = F.col("pillar5_low_confidence_share")
    conditions = (
        ("news_feed_latency", F.col("news_latency_p95_s") > latency_warn_s, F.col("news_latency_p95_s")),
        ("float_confidence", low > 0.5, low),
        ("news_feed_gap", F.col("ws_disconnect_minutes") > 0, F.col("ws_disconnect_minutes")),
        ("api_errors", F.col("api_errors") > 0, F.col("api_errors")),
        ("suspect_price", F.col("suspect_price_rows") > 0, F.col("suspect_price_rows")),
    )
    found = F.array_compact(F.array(*[
        F.when(met, F.struct(F.lit(code).alias("code"), value.cast("double").alias("value")))
        for code, met, value in conditions]))
    return rows.select("date", "table_name", F.inline(found))
