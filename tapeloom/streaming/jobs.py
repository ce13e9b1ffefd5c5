"""Live jobs: what runs on every micro-batch.

What the rows of a window share across batches is keyed state, or a small table
that each batch writes whole in a folder numbered by the batch. A batch reads
the folder of the one before and overwrites its own, so replaying it after a
crash changes nothing, and no batch reads what all earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapeloom.functions import timegrid as tg
from tapeloom.operators import push
from tapeloom.plans import window_poll
from tapeloom.session import written_once
from tapeloom.streaming import state
from tapeloom.streaming.feeds import PAYLOAD
from tapeloom.streaming.sources import each_batch, read_batches, write_batch

#: A window's pushes are remembered so long after it began.
WINDOW_LIFE = "interval 24 hours"


def news_within(tagged_news: DataFrame, polls: DataFrame, fresh_minutes: int) -> DataFrame:
    """Articles that can be fresh at one of the polls, by literal bounds that reach the scan."""
    low, high = polls.agg(F.min("poll_ts"), F.max("poll_ts")).first()
    return tagged_news.where(F.col("created_at").between(
        F.lit(low).cast("timestamp") - F.expr(f"interval {fresh_minutes} minutes"), F.lit(high).cast("timestamp")))


def evaluate_stream(polls: DataFrame, context: window_poll.PollContext, tagged_news: DataFrame,
                    root: str, now: Column, **facts) -> DataStreamWriter:
    """Judge, rank and push every poll as it lands; micro-batches hold whole polls.

    What a ticker had when first seen in its window is keyed state. The rows
    pushed in windows still alive, no more than the budget of each, come from
    the batch before: they lead the window's order, so the push decision finds
    budget and earlier tiers as if it saw the window from its start.
    """
    types = dict(polls.dtypes)
    fields = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    opened = state.first_seen(polls.select(
        "ticker", tg.window_start(F.col("poll_ts"), context.windows).alias("window_start"), "poll_ts",
        F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"),
        F.to_json(F.struct(*polls.columns), PAYLOAD).alias("poll")).where(F.col("window_start").isNotNull()))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # every read of a micro-batch runs its state again
        batch = written_once(batch, "opened-polls")
        rows = batch.select(F.from_json("poll", fields, PAYLOAD).alias("p"), "open_price", "open_volume").select(
            "p.*", "open_price", "open_volume")
        near = news_within(tagged_news, batch, context.thresholds.news_fresh_minutes)
        ranked = window_poll.rank_polls(window_poll.judge_polls(rows, context, near, **facts), context)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
        carried = read_batches(spark, root, "window_pushes", schema).where(F.col("batch_id") == batch_id - 1).select(
            *ranked.columns)
        decided = push.decide_pushes(
            ranked.withColumn("_carried", F.lit(False)).unionByName(carried.withColumn("_carried", F.lit(True))),
            context.push_rules)
        write_batch(window_poll.evaluation_rows(decided.where(~F.col("_carried")), now), root, "evaluations", batch_id)
        pushed = decided.where("pushed").select(*ranked.columns)
        last = pushed.agg(F.max("window_start")).first()[0]
        write_batch(pushed.where(F.col("window_start") >= F.lit(last).cast("timestamp") - F.expr(WINDOW_LIFE)), root, "window_pushes",
                    batch_id)

    return each_batch(opened, handle)
