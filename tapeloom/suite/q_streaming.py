"""Streams replayed from the tables and checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import PushRules
from tapeloom.operators import news as news_ops
from tapeloom.session import scratch_path, written_once
from tapeloom.sources import adapters as src
from tapeloom.sources import lake
from tapeloom.streaming import feeds, jobs, sources, state
from tapeloom.suite import q_lake as ql
from tapeloom.suite import q_plans as qp
from tapeloom.suite import q_rules as qr
from tapeloom.suite.registry import et, query, r, t, with_

FILES = 8
BATCHES = ("2024-01-09", "2024-01-17", "2024-01-25")


def in_files(part: DataFrame) -> DataFrame:
    """``part`` so that it is written into :data:`FILES` files, none empty, of stored rows without an exchange if they allow it."""
    joined = part.coalesce(FILES)
    filled = joined.select(F.spark_partition_id().alias("at")).distinct().count()
    return joined if filled == FILES else part.repartition(FILES)


def replay(df: DataFrame, ts: str, label: str, cuts=BATCHES, closing: str | None = None) -> DataFrame:
    """Land the rows in time order, a few files per step, and stream them back.

    One micro-batch reads one step, so state has to carry across batches.
    ``closing``, an interval, adds a last row of nulls that much later: it moves
    the watermark past everything before it and is never emitted itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"replay-{label}")
    # every step reads it
    df = written_once(df, f"landed-{label}")
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = df
        if low is not None:
            part = part.where(F.col(ts) >= F.lit(low).cast("timestamp"))
        if high is not None:
            part = part.where(F.col(ts) < F.lit(high).cast("timestamp"))
        in_files(part).write.mode("append").parquet(path)
    if closing is not None:
        last = df.agg((F.max(ts) + F.expr(f"interval {closing}")).alias(ts))
        last.select(*[F.col(c) if c == ts else F.lit(None).cast(k).alias(c) for c, k in df.dtypes]).write.mode(
            "append").parquet(path)
    fields = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    return sources.read_files(spark, path, fields, FILES)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run the stream to its end into a table and read that."""
    spark = stream.sparkSession
    path = scratch_path(spark, f"out-{label}")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    sources.drain(writer, scratch_path(spark, f"cp-{label}"))
    return spark.read.schema(stream.schema).parquet(path)


@query("i10_streaming_bars", with_("ticks", f"""SELECT ticker, {t(f"{et('minute')}::DATE",'date')}, {t('minute','minute')},
    {r('arg_min(price,ts)','open')}, {r('max(price)','high')}, {r('min(price)','low')}, {r('arg_max(price,ts)','close')},
    {r('sum(volume)','volume')}, count(*) AS trade_count FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS minute FROM ticks)
    GROUP BY ticker, minute"""))
def streaming_bars(spark, d):
    """Every bucket, emitted once the watermark has passed it."""
    ticks = src.ticks(spark, d).select("event_id", "ticker", "price", "volume", "ts")
    return drained(feeds.tumbling_bars(replay(ticks, "ts", "ticks", closing="1 day"), 15), "bars")


@query("i3_news_dedup", with_("news", f"""SELECT news_id, count(*) AS copies FROM news GROUP BY news_id"""))
def news_dedup(spark, d):
    """Every article arrives twice within the overlap and is kept once."""
    news = src.news(spark, d).select("news_id", "headline", "created_at", "received_at")
    twice = news.unionByName(news.withColumn(
        "received_at", F.timestamp_micros(F.unix_micros("received_at") + 30_000_000)))
    once = drained(feeds.first_arrivals(replay(twice, "created_at", "news")), "dedup")
    return once.groupBy("news_id").agg(F.count(F.lit(1)).alias("copies"))


@query("i11_backfill_replay", with_("news", """SELECT count(*) AS articles, count(DISTINCT news_id) AS distinct_articles FROM news"""))
def backfill_replay(spark, d):
    """Live feed with gaps, united with a replay that overlaps it."""
    news = src.news(spark, d).select("news_id", "headline", "created_at", "received_at")
    live = replay(news.where(F.hour("created_at") % 4 != 0), "created_at", "live")
    again = replay(news.where(F.hour("created_at") % 4 <= 1), "created_at", "again")
    merged = drained(feeds.with_backfill(live, again), "backfill")
    return merged.agg(F.count(F.lit(1)).alias("articles"),
                      F.count_distinct("news_id").alias("distinct_articles"))


@query("j3_callback_per_item", with_("news", f"""SELECT {t(f"{et('created_at')}::DATE",'date')}, count(*) AS n FROM news
    GROUP BY {et('created_at')}::DATE"""))
def callback_per_item(spark, d):
    """The callback gets every new article once and writes the news table."""
    root = scratch_path(spark, "lake")
    news = src.news(spark, d).drop("event_id")

    def callback(batch: DataFrame) -> None:
        lake.append(news_ops.news_rows(batch), root, "news", "stream")

    sources.drain(feeds.on_item(replay(news, "created_at", "items"), callback),
                  scratch_path(spark, "cp-items"))
    return lake.read_table(spark, root, "news").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("i9_buffered_lake_sink", with_("news", f"""SELECT {t(f"{et('created_at')}::DATE",'date')}, count(*) AS n,
    {r("sum((epoch_us(received_at)-epoch_us(created_at))/1000000.0::DOUBLE)",'latency')} FROM news
    GROUP BY {et('created_at')}::DATE"""))
def buffered_lake_sink(spark, d):
    """Contract-checked exactly-once sink, partitioned like the lake."""
    root = scratch_path(spark, "lake")
    stream = replay(src.news(spark, d).drop("event_id"), "created_at", "sink")
    sources.drain(sources.lake_sink(news_ops.news_rows(stream), root, "news", "stream"),
                  scratch_path(spark, "cp-sink"))
    return lake.read_table(spark, root, "news").groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("feed_latency_s").alias("latency"))


@query("i4_late_news_join", with_("purchases tagged", f"""SELECT p.event_id, m.last.i AS news_id,
    {t('m.last.c','news_created_at')} FROM purchases p LEFT JOIN (
      SELECT q.event_id, max(struct_pack(c := n.created_at, i := n.news_id)) AS last FROM purchases q
      JOIN tagged n ON n.ticker = q.ticker AND n.created_at <= q.ts AND n.created_at >= q.ts - INTERVAL 1440 MINUTE
      GROUP BY q.event_id) m USING (event_id)"""))
def late_news_join(spark, d):
    """Streaming as-of join: every poll with the latest article created up to a day before, or none."""
    polls = src.purchases(spark, d).select("event_id", "ticker", F.col("ts").alias("poll_ts"))
    tagged = news_ops.by_symbol(src.news(spark, d)).select("ticker", "news_id", "created_at")
    joined = feeds.latest_news(replay(polls, "poll_ts", "polls", closing="3 days"),
                               replay(tagged, "created_at", "tagged", closing="3 days"), 1440)
    return drained(joined, "late").select("event_id", "news_id", "news_created_at")


@query("i5_window_baseline_state", with_("polls", f"""SELECT ticker, {t('window_start','window_start')}, {t('poll_ts','poll_ts')},
    {r('open_price','open_price')}, {r('open_volume','open_volume')} FROM moved""", moved=qr.MOVED))
def window_baseline_state(spark, d):
    """First-seen state per ticker and window, over a stream of polls."""
    polls = src.polls(spark, d).withColumn("window_start", qr.four_hours(F.col("poll_ts"))).select(
        "ticker", "window_start", "poll_ts", "price", "volume")
    return drained(state.first_seen(replay(polls, "poll_ts", "first")), "first").select(
        "ticker", "window_start", "poll_ts", "open_price", "open_volume")


ORDER_CUTS = ("1997-01-01", "1999-01-01")
YEARS_MS = 20 * 366 * 24 * 3_600_000


@query("i6_change_only_state", with_("reference", f"""SELECT ticker, {t('seen_at','seen_at')}, o_orderkey, sector, industry
    FROM changes""", changes=qr.CHANGES))
def change_only_state(spark, d):
    """Change-only emission with the last values kept as state."""
    ref = src.reference(spark, d).select("ticker", "seen_at", "o_orderkey", "sector", "industry")
    stream = replay(ref, "seen_at", "reference", ORDER_CUTS)
    return drained(state.change_only(stream, ["ticker"], ["sector", "industry"],
                                     ["seen_at", "o_orderkey"], ttl_ms=YEARS_MS), "changes")


@query("i7_push_budget_state", with_("scored", f"""SELECT {t('window_start','window_start')}, brand AS ticker,
    {t('poll_ts','poll_ts')}, p::BIGINT AS level, l_orderkey FROM decided WHERE pushed""", decided=qr.PUSH_CTE))
def push_budget_state(spark, d):
    """Pushes of every window, decided while the polls stream in."""
    level = F.when(F.col("tier") == "A", 3).when(F.col("tier") == "B", 2).otherwise(0)
    rows = src.scored(spark, d).select(
        "window_start", F.col("brand").alias("ticker"), "poll_ts", level.alias("level"),
        (-F.col("l_quantity")).alias("neg_score"), "l_orderkey", "l_linenumber", "l_partkey")
    order = ["poll_ts", "neg_score", "ticker", "l_orderkey", "l_linenumber", "l_partkey"]
    stream = replay(rows, "window_start", "evals", ORDER_CUTS)
    return drained(state.budgeted_pushes(stream, order, PushRules(max_pushes=3).max_pushes), "pushes").select(
        "window_start", "ticker", "poll_ts", "level", "l_orderkey")


ALL_OUTAGES = """SELECT ts AS started, (SELECT min(u.ts) FROM health u WHERE u.state='up' AND u.ts > h.ts) AS ended
    FROM (SELECT *, lag(state) OVER (ORDER BY ts, event_id) AS prev FROM health) h
    WHERE state='down' AND prev IS DISTINCT FROM 'down'"""


@query("i8_feed_health_state", with_("health", f"""SELECT {t('started','started')}, {t('ended','ended')} FROM outages""",
    outages=ALL_OUTAGES))
def feed_health_state(spark, d):
    """Outages of one feed, those still open as well, which a timer reports while they last."""
    log = src.health(spark, d).select(F.lit("news").alias("feed"), "ts", "event_id", "state")
    found = state.outages(replay(log, "ts", "health", closing="3 days"), ["feed"], report_after_ms=30 * 60_000)
    # a long gap is told twice, the second time with its end
    return drained(found.where("feed IS NOT NULL"), "outages").groupBy("started").agg(F.max("ended").alias("ended"))


EVALUATION_FIELDS = (
    "ticker string, poll_ts_utc timestamp, window_start_utc timestamp, gap_pct double, window_change_pct double, "
    "pillar_1_status string, pillar_2_status string, pillar_3_status string, pillar_4_status string, "
    "pillar_5_status string, tier string, rank_score double, pushed boolean, push_reason string")
#: The second cut falls into the middle of a session, so that windows span batches.
LIVE_CUTS = ("2024-01-09", "2024-01-17 17:00:00", "2024-01-25")


@query("i1_streaming_evaluations", with_("polls tagged udaily", f"""SELECT ticker, {t('poll_ts','poll_ts_utc')},
    {t('window_start','window_start_utc')}, {r('gap','gap_pct')}, {r('wc','window_change_pct')}, p1 AS pillar_1_status,
    p2 AS pillar_2_status, p3 AS pillar_3_status, p4 AS pillar_4_status, p5 AS pillar_5_status, tier,
    {r('score','rank_score')}, pushed, push_reason FROM decided""", **qp.K1))
def streaming_evaluations(spark, d):
    """The live pipeline over a stream of polls: equal to the batch plan over all of them."""
    root = scratch_path(spark, "live")
    # every batch reads it
    daily = written_once(src.user_daily(spark, d), "daily")
    writer = jobs.evaluate_stream(
        replay(src.polls(spark, d), "poll_ts", "live", LIVE_CUTS), qp.CONTEXT,
        news_ops.by_symbol(src.news(spark, d)), root, ql.now(), prev_closes=daily,
        recent_runners=daily.where(F.col("close") / F.col("prev_close") >= 20))
    sources.drain(writer, scratch_path(spark, "cp-live"))
    return sources.read_batches(spark, root, "evaluations", EVALUATION_FIELDS).drop("batch_id")
