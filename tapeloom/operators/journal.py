"""The trader's journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.metrics import realised_pnl
from tapeloom.operators.scan import top_rows

ACTIONS = ("traded", "skipped", "watched")


def decode_tags(tags: Column) -> Column:
    """JSON text to an array; nothing stored is an empty list."""
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def encode_tags(tags: Column) -> Column:
    return F.to_json(tags)


def export_rows(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the ``journal`` table."""
    return entries.select(
        "ticker", "date",
        (F.col("alert_id") if "alert_id" in entries.columns else F.lit(None).cast("string"))
        .alias("alert_id"),
        "action", "entry", "exit", "size",
        (F.col("note") if "note" in entries.columns else F.lit(None).cast("string")).alias("note"),
        decode_tags(F.col("tags_json")).alias("tags"),
        F.col("created_at").alias("created_at_utc"),
        (F.col("created_at") if now is None else now).alias("written_at_utc"))


def latest_actions(entries: DataFrame) -> DataFrame:
    """The last action per ticker and day."""
    return entries.groupBy("ticker", "date").agg(
        F.max_by("action", F.struct("created_at", "entry_id")).alias("action"))


def pnl(entries: DataFrame) -> DataFrame:
    return entries.withColumn("pnl", realised_pnl(
        F.col("action"), F.col("entry"), F.col("exit"), F.col("size")))


def recent_per_ticker(entries: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` entries of every ticker."""
    return top_rows(entries, ["ticker"], [F.desc("created_at"), F.desc("entry_id")], n, "place")
