"""Feed payloads in the shapes the readers expect, landed from the driver tables.

Documents hold a bounded page of records, so building one never gathers an
unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import scratch_path
from tapeloom.sources import adapters as src

PAGE = 50
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def land(lines: DataFrame, label: str) -> DataFrame:
    """Write the lines to the shared folder as JSON text and read them back."""
    spark = lines.sparkSession
    path = scratch_path(spark, f"landed-{label}")
    lines.write.json(path, compression="gzip", timestampFormat=MICROS)
    return spark.read.schema(lines.schema).json(path, timestampFormat=MICROS)


def scanner_payloads(spark: SparkSession, sf_dir: str, broken_arity: bool = False) -> DataFrame:
    """One payload per 50 events: positional rows, some with an unusable close; some payloads once more, cut off."""
    t = src.ticks(spark, sf_dir).withColumn("page", F.floor(F.col("event_id") / PAGE))
    number = F.concat(F.lit('"'), F.lit("n/a"), F.lit('"'))
    close = F.when(F.col("event_id") % 97 == 0, number).otherwise(F.col("price").cast("string"))
    kind = F.when(F.col("event_id") % 11 == 0, F.lit('"fund"')).when(
        F.col("event_id") % 13 == 0, F.lit("null")).otherwise(F.lit('"stock"'))
    specs = F.when(F.col("event_id") % 7 == 0, F.lit('["ETF"]')).otherwise(F.lit('["common"]'))
    shares = F.when(F.col("event_id") % 5 == 0, F.lit("-1.0")).otherwise(
        (F.col("user_id") * 1000 + 500.7).cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("nyse:"), F.lower("uticker"))) \
        .otherwise(F.lower("uticker"))
    venue = F.when(F.col("event_id") % 17 == 0, F.lit("OTC")).otherwise(F.lit("nasdaq"))
    cells = [
        quoted(name), F.lit('"d"'), quoted(venue), kind, specs, close, F.lit("1.5"),
        F.col("volume").cast("string"), F.lit("null"), F.lit("null"), F.lit("null"), shares,
        F.lit("null"), F.lit("null"), quoted(F.col("ticker")), F.lit("null"),
        *[F.lit("null")] * (5 if broken_arity else 6),
    ]
    row = F.concat(F.lit('{"s":"X:Y","d":['), F.concat_ws(",", *cells), F.lit("]}"))
    docs = t.groupBy("page").agg(
        F.min("ts").alias("poll_ts"), F.sort_array(F.collect_list(row)).alias("rows"))
    value = F.concat(F.lit('{"totalCount":'), F.size("rows").cast("string"), F.lit(',"data":['),
                     F.concat_ws(",", "rows"), F.lit("]}"))
    cut_off = docs.where(F.col("page") % 40 == 7).select(
        "poll_ts", F.lit('{"totalCount":1,"data":[{"s":"X:Y","d":[').alias("value"))
    return land(docs.select("poll_ts", value.alias("value")).unionByName(cut_off), "scanner")


def bar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per ticker-day; every seventh hour's first bar lacks its close."""
    bars = src.bars(spark, sf_dir)
    broken = (F.hour("minute") % 7 == 0) & (F.minute("minute") == 0)
    rec = F.to_json(F.struct(
        F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.when(~broken, F.col("close")).alias("c"), F.col("volume").alias("v"),
        F.col("trade_count").alias("n"), F.col("vwap").alias("vw")))
    pages = bars.groupBy("ticker", "date").agg(F.sort_array(F.collect_list(rec)).alias("r"))
    value = F.concat(F.lit('{"bars":{"'), F.col("ticker"), F.lit('":['),
                     F.concat_ws(",", "r"), F.lit(']},"next_page_token":null}'))
    garbage = pages.where(F.dayofmonth("date") == 3).select(F.lit("<html>busy</html>").alias("value"))
    return land(pages.select(value.alias("value")).unionByName(garbage), "bars")


def news_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News frames alone or in arrays, with control, error and broken lines between."""
    t = src.ticks(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    item = F.to_json(F.struct(
        F.lit("n").alias("T"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 19 != 0, F.concat(F.lit("headline "), F.col("event_id")))
        .alias("headline"),
        F.array(F.lower("uticker"), F.lit("")).alias("symbols"),
        F.when(F.col("event_id") % 2 == 0, "desk").alias("source"),
        stamp.alias("created_at")))
    value = (
        F.when(F.col("ticker") == "signup", F.when(F.col("event_id") % 2 == 0, item).otherwise(
            F.concat(F.lit("["), item, F.lit(',{"T":"subscription","news":["*"]}]'))))
        .when(F.col("ticker") == "error", F.lit('{"T":"error","msg":"slow client"}'))
        .when(F.col("ticker") == "view", F.lit('{"T":"success","msg":"authenticated"}'))
        .when(F.col("ticker") == "click", F.lit('{"T":"n", broken'))
    )
    lines = t.select(value.alias("value"), F.col("ts").alias("received_at")).where(
        F.col("value").isNotNull())
    return land(lines, "news")


def second_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company news with epoch seconds; some records lack their time."""
    t = src.ticks(spark, sf_dir).where(F.col("ticker") == "purchase")
    body = F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.concat(F.lit("story "), F.col("event_id")).alias("headline"),
        F.when(F.col("event_id") % 23 != 0, F.unix_seconds("ts")).alias("datetime"),
        F.when(F.col("event_id") % 2 == 0, "paper").alias("source"), F.lit("u").alias("url")))
    return land(t.select(F.lower("uticker").alias("ticker"), F.col("ts").alias("received_at"),
                         body.alias("value")), "second")


def action_payloads(spark: SparkSession, sf_dir: str, actions: DataFrame | None = None) -> DataFrame:
    """Corporate actions by kind, a page of tickers each; dates sit in varying fields."""
    a = (src.actions(spark, sf_dir) if actions is None else actions).withColumn("key", F.expr("int(substring(ticker, 2))"))
    day = F.col("effective_date").cast("string")
    split = F.col("ratio").isNotNull()
    rec = F.to_json(F.struct(
        F.when(split, F.lower("ticker")).alias("symbol"),
        "old_symbol", "new_symbol",
        F.when(F.col("key") % 3 == 0, day).alias("ex_date"),
        F.when(F.col("key") % 3 == 1, day).alias("process_date"),
        F.when((F.col("key") % 3 == 2) & (F.col("key") % 5 != 0), day).alias("effective_date"),
        F.when(split, F.lit(10)).alias("old_rate"),
        F.when(split, F.round(F.col("ratio") * 10)).alias("new_rate")))
    kind = F.when(F.col("action_type") == "forward_split", "unit_split").when(
        F.col("action_type") == "symbol_change", "name_change").otherwise("reverse_split")
    pages = a.groupBy(kind.alias("kind"), F.floor(F.col("key") / PAGE).alias("page")).agg(
        F.sort_array(F.collect_list(rec)).alias("r"))
    value = F.concat(F.lit('{"corporate_actions":{"'), F.col("kind"), F.lit('":['),
                     F.concat_ws(",", "r"), F.lit("]}}"))
    garbage = pages.where(F.col("page") == 0).select(F.lit('{"message":"try later"}').alias("value"))
    return land(pages.select(value.alias("value")).unionByName(garbage), "actions")
