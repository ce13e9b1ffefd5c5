"""Streaming bars and news."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapeloom.config import BACKFILL_MINUTES
from tapeloom.functions import timegrid as tg
from tapeloom.streaming import state
from tapeloom.streaming.sources import each_batch

#: How a row travels through keyed state as one text.
PAYLOAD = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def tumbling_bars(ticks: DataFrame, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """OHLCV per ticker and bucket, emitted once the watermark passes it."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        )
        .select("ticker", tg.et_date(F.col("w.start")).alias("date"),
                F.col("w.start").alias("minute"), "open", "high", "low", "close", "volume",
                "trade_count")
    )


def first_arrivals(news: DataFrame, overlap_minutes: int = BACKFILL_MINUTES) -> DataFrame:
    """Each article once, however often reconnects replay it within the overlap."""
    return news.withWatermark("created_at", f"{overlap_minutes} minutes") \
        .dropDuplicatesWithinWatermark(["news_id"])


def with_backfill(live: DataFrame, replayed: DataFrame,
                  overlap_minutes: int = BACKFILL_MINUTES) -> DataFrame:
    """The live stream and the replay after a reconnect, as one feed."""
    return first_arrivals(live.unionByName(replayed), overlap_minutes)


def backfill_window(now: datetime, minutes: int = BACKFILL_MINUTES) -> tuple[datetime, datetime]:
    """The span to replay after a (re)connection."""
    return now - timedelta(minutes=minutes), now


def latest_news(polls: DataFrame, tagged: DataFrame, fresh_minutes: int,
                lateness: str = "60 minutes") -> DataFrame:
    """Every poll once, with the latest article of its ticker still fresh at the poll, or NULL.

    Time is cut into spans as long as an article stays fresh, so a poll needs the
    articles of its own span and of the one before: an article is sent to two
    keys, and a ticker with many rows is many keys. Articles are kept in time
    order, late ones put in their place; a poll is answered once the watermark
    has passed it. Of articles created at one moment the largest id counts.
    """
    span = fresh_minutes * 60_000_000
    # a row without a ticker only moves the watermark; as a filter would be pushed below it, the state skips the row
    named = F.col("ticker").isNotNull()
    asked = polls.select(
        "ticker", F.col("poll_ts").alias("at"), F.when(named, F.to_json(F.struct(*polls.columns), PAYLOAD)).alias("poll"),
        F.lit(None).cast("string").alias("news_id"),
        F.floor(F.unix_micros("poll_ts") / span).alias("span"))
    own = F.floor(F.unix_micros("created_at") / span)
    told = tagged.select(
        "ticker", F.col("created_at").alias("at"), F.lit(None).cast("string").alias("poll"),
        F.when(named, F.col("news_id").cast("string")).alias("news_id"), F.explode(F.array(own, own + 1)).alias("span"))
    # the slower of the two sets the watermark
    both = asked.withWatermark("at", lateness).unionByName(told.withWatermark("at", lateness))
    kind = dict(tagged.dtypes)["news_id"]
    answered = state.latest_in_span(both, span, numeric=kind in ("bigint", "int"))
    fields = ", ".join(f"`{name}` {of}" for name, of in polls.dtypes)
    return answered.select(
        F.from_json("poll", fields, PAYLOAD).alias("p"), F.col("news_id").cast(kind).alias("news_id"),
        "news_created_at").select("p.*", "news_id", "news_created_at")


def on_item(news: DataFrame, callback: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Hand every micro-batch of new articles to ``callback``."""
    return each_batch(news, lambda df, _batch_id: callback(df))
