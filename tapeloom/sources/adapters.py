"""The suite's input shapes, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.config import PillarThresholds
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators import bars as bar_ops
from tapeloom.operators.scan import latest_rows
from tapeloom.session import prepare, written_once

BAR_MINUTES = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: event type as ticker, user as the fine-grained ticker."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("ticker"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("uticker"),
        (F.col("value") + 1).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).cast("double").alias("volume"),
        ts.alias("ts"),
        tg.et_date(ts).alias("date"),
    )


def bars(spark: SparkSession, sf_dir: str, minutes: int = BAR_MINUTES) -> DataFrame:
    return bar_ops.build_bars(ticks(spark, sf_dir), minutes)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.regular_closes(bars(spark, sf_dir))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly snapshots: latest trade per user, volume so far that day."""
    t = ticks(spark, sf_dir).withColumn("poll_ts", F.date_trunc("hour", F.col("ts")))
    last = t.groupBy("poll_ts", "uticker").agg(
        F.max_by(F.struct("price", "user_id", "date"), F.struct("ts", "event_id")).alias("r"),
        F.sum("volume").alias("hour_volume"),
    )
    # one row per ticker and hour: at most 24 rows in a ticker-day
    day = W.partitionBy("uticker", "date").orderBy("poll_ts").rowsBetween(
        W.unboundedPreceding, 0)
    rows = last.select("poll_ts", "uticker", "hour_volume", "r.*").withColumn(
        "volume", F.sum("hour_volume").over(day)
    )
    means = t.groupBy("uticker").agg(
        F.avg("price").alias("mean_price"), (30 * F.avg("volume")).alias("average_volume_10d")
    )
    return rows.join(means, "uticker").select(
        F.col("uticker").alias("ticker"), "user_id", "poll_ts", "date", "price", "volume",
        ((F.col("price") / F.col("mean_price") - 1) * 100).alias("change_pct"),
        "average_volume_10d",
        F.when(F.col("user_id") % 10 != 0, (F.col("user_id") % 30 + 1) * 1_000_000)
        .alias("float_shares"),
    )


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inputs of the five rules, from order lines."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    ship = F.col("l_shipdate").cast("timestamp")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            tg.plus_minutes(ship, F.col("l_linenumber")).alias("poll_ts"),
            ship.alias("window_start"),
            (F.col("l_discount") * 300).alias("gap_pct"),
            (F.col("l_quantity") / 5).alias("rvol"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("long") * 1_000_000)
            .alias("float_shares"),
            F.when(F.col("l_linenumber") == 7, "low").otherwise("medium").alias("confidence"),
            F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 300).alias("news_age"),
            (F.col("o_orderpriority") == "1-URGENT").alias("was_runner"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            F.col("p_brand").alias("brand"),
        )
    )


def scored(spark: SparkSession, sf_dir: str, th: PillarThresholds | None = None) -> DataFrame:
    """``evals`` with the five verdicts, their counts and the tier."""
    return score(evals(spark, sf_dir), th or PillarThresholds())


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` as a stored table, the way the nightly jobs find it."""
    return written_once(scored(spark, sf_dir), "evaluations")


def score(df: DataFrame, th: PillarThresholds) -> DataFrame:
    c = F.col
    out = df.withColumns({
        "p1": rules.up_on_day(c("gap_pct"), th),
        "p2": rules.relative_volume(c("rvol"), th),
        "p3": rules.news_catalyst(c("news_age"), th),
        "p4": rules.price_range(c("price"), th),
        "p5": rules.small_float(c("float_shares"), c("confidence"), th),
    })
    statuses = [c(f"p{i}") for i in range(1, 6)]
    return out.withColumns({
        "passed": rules.status_count(statuses, "pass"),
        "unknown": rules.status_count(statuses, "unknown"),
        "tier": rules.tier(statuses),
    })


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow fields observed over time, from orders."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderdate").cast("timestamp").alias("seen_at"),
        F.col("o_orderpriority").alias("sector"),
        F.col("o_orderstatus").alias("industry"),
        F.col("o_totalprice").alias("market_cap"),
        "o_orderkey",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with two clocks and two symbols, from sign-up events."""
    t = ticks(spark, sf_dir).where(F.col("ticker") == "signup")
    other = F.concat(F.lit("U"), ((F.col("user_id") * 7) % 150).cast("string"))
    return t.select(
        F.col("event_id").cast("string").alias("news_id"),
        F.array(F.col("uticker"), other).alias("symbols"),
        F.concat(F.lit("headline "), F.col("event_id").cast("string")).alias("headline"),
        F.lit("wire").alias("news_source"),
        F.lit(None).cast("string").alias("url"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.timestamp_micros(
            F.unix_micros("ts") + ((F.col("volume") - 1) * 1_000_000).cast("long")
        ).alias("received_at"),
        F.col("event_id"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments to look news up at, from purchase events."""
    return ticks(spark, sf_dir).where(F.col("ticker") == "purchase").select(
        "event_id", F.col("uticker").alias("ticker"), F.col("ts"), "date"
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions, from small parts."""
    part = table(spark, sf_dir, "part").where(F.col("p_size") <= 3)
    size = F.col("p_size")
    ticker = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return part.select(
        ticker.alias("ticker"),
        F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int"))
        .alias("effective_date"),
        F.when(size == 1, "reverse_split").when(size == 2, "forward_split")
        .otherwise("symbol_change").alias("action_type"),
        F.when(size == 1, 0.1).when(size == 2, 3.0).alias("ratio"),
        F.when(size == 3, ticker).alias("old_symbol"),
        F.when(size == 3, F.concat(F.lit("P"), (F.col("p_partkey") + 1).cast("string")))
        .alias("new_symbol"),
    )


def user_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and renames moved onto users and January days."""
    part = F.substring("ticker", 2, 20).cast("long")
    return actions(spark, sf_dir).select(
        F.concat(F.lit("U"), (part % 120).cast("string")).alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (part % 30).cast("int")).alias("effective_date"),
        "action_type", "ratio", "old_symbol", "new_symbol")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade decisions, from orders."""
    o = table(spark, sf_dir, "orders")
    entry = F.col("o_totalprice") / 100
    return o.select(
        F.col("o_orderkey").alias("entry_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "traded")
        .when(F.col("o_orderstatus") == "O", "skipped").otherwise("watched").alias("action"),
        entry.alias("entry"),
        F.when(F.col("o_orderkey") % 2 == 0, entry * 1.02).alias("exit"),
        (F.col("o_custkey") % 100).cast("double").alias("size"),
        F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('","'), F.col("o_orderstatus"),
                 F.lit('"]')).alias("tags_json"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed connection log: ``error`` drops it, ``signup`` restores it."""
    t = ticks(spark, sf_dir).where(F.col("ticker").isin("error", "signup"))
    return t.select(
        "event_id", "ts", F.to_date("ts").alias("day"),
        F.when(F.col("ticker") == "error", "down").otherwise("up").alias("state"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays on which anything traded, with an ordinal.

    The ordinal window has one row per calendar day.
    """
    days = (
        ticks(spark, sf_dir).select("date").distinct()
        .where(~F.dayofweek("date").isin(1, 7))
    )
    return days.withColumn("ord", F.row_number().over(W.orderBy("date")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest evaluation per poll and ticker, one row each."""
    df = scored(spark, sf_dir)
    return latest_rows(
        df, ["ticker", "poll_ts"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    )


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with users as tickers: many names, few trades a day."""
    t = ticks(spark, sf_dir).drop("ticker").withColumnRenamed("uticker", "ticker")
    return bar_ops.build_bars(t, BAR_MINUTES)


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last close per user and day, with the one before it."""
    return daily_of(user_bars(spark, sf_dir))


def daily_of(bars: DataFrame) -> DataFrame:
    """:func:`user_daily` from bars at hand."""
    days = bars.groupBy("ticker", "date").agg(F.max_by("close", "minute").alias("close"))
    return days.withColumn(
        "prev_close", F.lag("close").over(W.partitionBy("ticker").orderBy("date")))


def day_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored evaluations moved onto users and January days; some users get none."""
    start = F.lit("2024-01-01").cast("date")
    moved = evals(spark, sf_dir).withColumns({
        "ticker": F.concat(F.lit("U"), (F.col("l_partkey") % 120).cast("string")),
        "date": F.date_add(start, (F.col("l_orderkey") % 30).cast("int")),
    })
    noon = tg.plus_minutes(F.col("date").cast("timestamp"), 720 + F.col("l_linenumber"))
    return score(moved.withColumn("poll_ts", noon), PillarThresholds())


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with the two figures the nightly jobs summarise."""
    return polls(spark, sf_dir).withColumns({
        "gap_pct": F.col("change_pct"),
        "rvol": F.col("volume") / (F.col("average_volume_10d") * 0.05),
    })


def known_listings(spark: SparkSession, sf_dir: str, cutoff: str) -> DataFrame:
    """Parts shipped before ``cutoff``, as listings."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(cutoff).cast("date"))
    return li.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker")).agg(
        F.to_date(F.min("l_shipdate")).alias("first_seen"),
        F.to_date(F.max("l_shipdate")).alias("last_seen"),
    ).withColumns({"status": F.lit("active"), "ticker_canonical_id": F.lit(None).cast("string")})
