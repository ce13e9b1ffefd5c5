"""Listing lifecycle: first and last seen, delistings and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.calendar import sessions_upto
from tapeloom.operators.scan import asof_join
from tapeloom.session import cut_lineage

BEFORE_TIME = "0001-01-01"
COLUMNS = ("ticker", "first_seen", "last_seen", "status", "ticker_canonical_id")


def transitions(known: DataFrame, seen: DataFrame, day: Column, absent_days: int = 5,
                sessions: DataFrame | None = None) -> DataFrame:
    """Known listings merged with the tickers of one day.

    A listing is gone after ``absent_days`` days without it: calendar days, or
    the trading days (``date``) in ``sessions``, of which holidays are none.
    """
    today = seen.select("ticker").distinct().withColumn("_seen", F.lit(True))
    both = known.join(today, "ticker", "full_outer")
    here = F.coalesce("_seen", F.lit(False))
    absent = F.datediff(day, F.col("last_seen"))
    if sessions is not None:
        placed = sessions_upto(known.select(F.col("last_seen").alias("date")), sessions)
        both = both.join(placed.withColumnRenamed("date", "last_seen"), "last_seen", "left")
        today_at = sessions.agg(F.count_if(F.col("date") <= day)).scalar()
        absent = today_at - F.col("_upto")
    gone = (absent >= absent_days) & (F.col("status") == "active")
    return both.select(
        "ticker",
        F.coalesce(F.col("first_seen"), day).alias("first_seen"),
        F.when(here, day).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, "active").when(gone, "delisted").otherwise(F.col("status")).alias("status"),
        "ticker_canonical_id",
    )


def rename_roots(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Each rename with the oldest symbol behind it and the span inherited.

    Chains are followed by pointer doubling: a chain of n renames takes
    log2(n) joins, and every round starts from a checkpoint. A rename continues
    the latest earlier one into its old symbol; dates strictly decrease along
    the way, so there is no cycle.
    """
    edge = changes.select(
        F.col("old_symbol").alias("old"), F.col("new_symbol").alias("new"),
        F.col("effective_date").alias("day")).distinct()
    probes = edge.withColumns({
        "symbol": F.col("old"), "_at": F.date_sub("day", 1).cast("timestamp")})
    earlier = edge.select(
        F.col("new").alias("symbol"), F.col("day").cast("timestamp").alias("_day"),
        F.col("old").alias("p_old"), F.col("new").alias("p_new"), F.col("day").alias("p_day"))
    linked = asof_join(probes, earlier, ["symbol"], "_at", "_day", ["p_old", "p_new", "p_day"],
                       ["p_old"], "month", "parent")
    span = known.select(
        "ticker", F.struct("first_seen", "last_seen").alias("span"),
        F.coalesce("ticker_canonical_id", "ticker").alias("canon"))
    state = (
        linked.select("old", "new", "day", "parent")
        .join(span.select(F.col("ticker").alias("new"), F.col("span").alias("s_new")), "new", "left")
        .join(span.select(F.col("ticker").alias("old"), F.col("span").alias("s_old"),
                          "canon"), "old", "left")
        .select("old", "new", "day", F.coalesce("s_new", "s_old").alias("span"),
                F.coalesce("canon", "old").alias("root"), F.col("parent").alias("ptr"))
    )
    state = cut_lineage(state)
    while not state.where(F.col("ptr").isNotNull()).isEmpty():
        up = state.select(
            F.struct(F.col("old").alias("p_old"), F.col("new").alias("p_new"),
                     F.col("day").alias("p_day")).alias("ptr"),
            F.col("span").alias("u_span"), F.col("root").alias("u_root"),
            F.col("ptr").alias("u_ptr"))
        state = cut_lineage(state.join(up, "ptr", "left").select(
            "old", "new", "day", F.coalesce("span", "u_span").alias("span"),
            F.coalesce("u_root", "root").alias("root"), F.col("u_ptr").alias("ptr")))
    return state.select("old", "new", "day", "span", "root")


def apply_renames(known: DataFrame, changes: DataFrame) -> DataFrame:
    """Listings after all renames; both ends keep the oldest symbol as identity."""
    roots = rename_roots(changes, known)
    facts = roots.select(F.col("new").alias("ticker"), "day", F.lit(1).alias("side"), "span", "root")
    facts = facts.unionByName(roots.select(
        F.col("old").alias("ticker"), "day", F.lit(0).alias("side"), "span", "root"))
    last = facts.groupBy("ticker").agg(
        F.max_by(F.struct("side", "root"), F.struct("day", "side")).alias("last"),
        F.min_by("span", F.when(F.col("side") == 1, F.col("day"))).alias("span"),
        F.max("side").alias("was_new"))
    merged = known.join(last, "ticker", "full_outer")
    never = F.lit(BEFORE_TIME).cast("date")
    renamed = F.col("last").isNotNull()
    return merged.where(F.col("first_seen").isNotNull() | (F.col("was_new") == 1)).select(
        "ticker",
        F.coalesce("first_seen", F.col("span.first_seen"), never).alias("first_seen"),
        F.coalesce("last_seen", F.col("span.last_seen"), never).alias("last_seen"),
        F.when(renamed & (F.col("last.side") == 0), "renamed").when(renamed, "active")
        .otherwise(F.col("status")).alias("status"),
        F.when(renamed, F.col("last.root")).otherwise(F.col("ticker_canonical_id"))
        .alias("ticker_canonical_id"))
