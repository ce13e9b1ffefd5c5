"""Readers for landed feed payloads: one JSON document per line.

A bad record is counted and kept aside, never fatal; a changed column contract
is fatal at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg

#: Positional columns of a scanner row, in feed order.
SCANNER_COLUMNS = (
    "name",
    "description",
    "exchange",
    "type",
    "typespecs",
    "close",
    "change",
    "volume",
    "average_volume_10d_calc",
    "average_volume_30d_calc",
    "relative_volume_10d_calc",
    "float_shares_outstanding",
    "total_shares_outstanding",
    "market_cap_basic",
    "sector",
    "industry",
    "premarket_close",
    "premarket_change",
    "premarket_volume",
    "postmarket_close",
    "postmarket_change",
    "postmarket_volume",
)
ESSENTIAL_COLUMNS = ("name", "close", "volume")
_TEXT = ("name", "description", "exchange", "type", "typespecs", "sector", "industry")
_SHARES = ("float_shares_outstanding", "total_shares_outstanding")
#: Typed name of each numeric scanner column.
_TYPED = {
    "close": "close",
    "change": "change_pct",
    "volume": "volume",
    "average_volume_10d_calc": "average_volume_10d",
    "average_volume_30d_calc": "average_volume_30d",
    "relative_volume_10d_calc": "relative_volume_10d",
    "float_shares_outstanding": "float_shares",
    "total_shares_outstanding": "shares_outstanding",
    "market_cap_basic": "market_cap",
    "premarket_close": "premarket_close",
    "premarket_change": "premarket_change_pct",
    "premarket_volume": "premarket_volume",
    "postmarket_close": "postmarket_close",
    "postmarket_change": "postmarket_change_pct",
    "postmarket_volume": "postmarket_volume",
}
#: Feed vocabulary of corporate actions onto the lake's.
ACTION_TYPES = {
    "forward_split": "forward_split",
    "reverse_split": "reverse_split",
    "unit_split": "forward_split",
    "stock_dividend": "stock_dividend",
    "cash_dividend": "cash_dividend",
    "name_change": "symbol_change",
    "symbol_change": "symbol_change",
    "worthless_removal": "delisting",
    "delisting": "delisting",
}
#: What a payload of each feed must hold to be readable at all.
PAYLOADS = {
    "scanner": ("data array<struct<s:string,d:array<string>>>", "data"),
    "bars": ("bars map<string,array<struct<t:string>>>", "bars"),
    "actions": ("corporate_actions map<string,array<struct<symbol:string>>>", "corporate_actions"),
}


class ContractChanged(ValueError):
    """An essential feed column is gone."""


def missing_columns(returned: Sequence[str],
                    requested: Sequence[str] = SCANNER_COLUMNS) -> list[str]:
    """Requested columns that did not come back; an essential one is fatal."""
    missing = [name for name in requested if name not in set(returned)]
    lost = [name for name in missing if name in ESSENTIAL_COLUMNS]
    if lost:
        raise ContractChanged(f"feed lacks essential columns {lost}")
    return missing


def payload_counts(lines: DataFrame, feed: str, by: Sequence[str] = ()) -> DataFrame:
    """``payloads`` landed and ``unreadable`` ones among them.

    A payload that is not the feed's JSON yields no record, so only a count of
    payloads can show it.
    """
    schema, field = PAYLOADS[feed]
    readable = F.from_json("value", schema)[field].isNotNull()
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("payloads"), F.count_if(~readable).alias("unreadable"))


# --- scanner snapshots -----------------------------------------------------

def scanner_records(lines: DataFrame, poll_ts: str = "poll_ts") -> DataFrame:
    """Positional arrays of ``(poll_ts, value)`` payloads as named text columns.

    The array must match the column contract, else the job fails.
    """
    payload = F.from_json("value", "data array<struct<s:string,d:array<string>>>")
    items = lines.select(poll_ts, F.inline(payload["data"]))
    wanted = len(SCANNER_COLUMNS)
    found = F.coalesce(F.size("d"), F.lit(0))
    checked = F.when(found == wanted, F.col("d")).otherwise(F.raise_error(F.concat(
        F.lit("scanner row has "), found.cast("string"),
        F.lit(f" values for {wanted} columns; the column contract has changed"))))
    named = items.select(poll_ts, "s", checked.alias("d")).select(
        poll_ts, "s", *[F.col("d")[i].alias(name) for i, name in enumerate(SCANNER_COLUMNS)])
    return named.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("s"))).drop("s")


def scanner_rows(records: DataFrame, poll_ts: str = "poll_ts") -> DataFrame:
    """Typed rows with ``parse_error`` set where a value is not a number."""
    name = F.coalesce("name", F.lit(""))
    qualified = name.contains(":")
    symbol = F.when(qualified, F.substring_index(name, ":", -1)).otherwise(name)
    exchange = F.when(qualified, F.substring_index(name, ":", 1)).otherwise(
        F.coalesce("exchange", F.lit("")))

    def number(col: str) -> Column:
        value = F.col(col).try_cast("double")
        return m.share_count(value) if col in _SHARES else m.not_nan(value)

    bad = F.coalesce(*[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(),
               F.lit(f"{c} is not a number"))
        for c in _TYPED
    ])
    return records.select(
        poll_ts, F.upper(symbol).alias("ticker"), F.upper(exchange).alias("exchange"),
        "description", F.col("type").alias("instrument_type"),
        F.coalesce(F.from_json("typespecs", "array<string>"),
                   F.array().cast("array<string>")).alias("typespecs"),
        *[number(c).alias(typed) for c, typed in _TYPED.items()],
        "sector", "industry", bad.alias("parse_error"),
    )


def tradable(rows: DataFrame) -> DataFrame:
    """Rows that parsed and are listed common stock."""
    return rows.where(F.col("parse_error").isNull() & rules.common_stock(
        F.col("instrument_type"), F.col("typespecs"), F.col("exchange"))).drop("parse_error")


def poll_report(rows: DataFrame, lines: DataFrame, missing: Sequence[str] = (),
                poll_ts: str = "poll_ts") -> DataFrame:
    """Kept, unparsable and excluded rows and unreadable payloads per poll, with the errors met.

    There is one possible message per column, so their set is bounded by the
    contract. A poll without a readable payload has its row all the same.
    """
    good = F.col("parse_error").isNull()
    stock = rules.common_stock(F.col("instrument_type"), F.col("typespecs"), F.col("exchange"))
    seen = rows.groupBy(poll_ts).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good & stock).alias("kept"),
        F.count_if(~good).alias("unparsable"),
        F.count_if(good & ~stock).alias("excluded_non_stock"),
        F.sort_array(F.collect_set("parse_error")).alias("errors"),
    )
    polls = payload_counts(lines, "scanner", [poll_ts]).drop("payloads").join(seen, poll_ts, "left")
    counts = ["total", "kept", "unparsable", "excluded_non_stock"]
    return polls.select(
        poll_ts, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "unreadable",
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    ).withColumn("degraded", (F.col("unparsable") + F.col("unreadable") > 0) | F.lit(bool(missing)))


def busiest_above(rows: DataFrame, min_price: float, limit: int = 20_000,
                  ties: Sequence[str] = ("ticker",)) -> DataFrame:
    """The scan's own request: a price floor, busiest first, capped."""
    return rows.where(F.col("close") >= min_price).orderBy(F.desc("volume"), *ties).limit(limit)


# --- bars ------------------------------------------------------------------

_BAR = "struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>"


def bar_records(pages: DataFrame) -> DataFrame:
    """Bars of ``{"bars": {SYM: [..]}}`` pages; ``valid`` is false if a field lacks."""
    payload = F.from_json("value", f"bars map<string,array<{_BAR}>>")
    by_symbol = pages.select(F.explode(payload["bars"]).alias("symbol", "records"))
    rows = by_symbol.select(F.upper("symbol").alias("ticker"), F.inline("records"))
    need = [F.col(c).isNotNull() for c in ("o", "h", "l", "c", "v")]
    minute = F.try_to_timestamp("t")
    valid = minute.isNotNull()
    for one in need:
        valid = valid & one
    return rows.select(
        "ticker", minute.alias("minute"), F.col("o").alias("open"), F.col("h").alias("high"),
        F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"),
        F.col("vw").alias("vwap"), F.col("n").alias("trade_count"), valid.alias("valid"))


def valid_bars(records: DataFrame) -> DataFrame:
    return records.where("valid").drop("valid")


def missing_symbols(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers that returned nothing."""
    return requested.select("ticker").distinct().join(
        bars.select("ticker").distinct(), "ticker", "left_anti")


def bar_rows(bars: DataFrame, written_at: Column, resolution_minutes: int = 1) -> DataFrame:
    """Rows of the ``bars_1m`` table."""
    return bars.select(
        "ticker", tg.et_date(F.col("minute")).alias("date"), F.col("minute").alias("minute_utc"),
        "open", "high", "low", "close", "volume", "trade_count", "vwap",
        F.lit(resolution_minutes).alias("resolution_minutes"),
        written_at.alias("written_at_utc"))


# --- news ------------------------------------------------------------------

_FRAME = (
    "struct<T:string,id:string,headline:string,symbols:array<string>,source:string,url:string,"
    "created_at:string,updated_at:string,msg:string>"
)


def news_frames(lines: DataFrame) -> DataFrame:
    """Every frame of ``(value, received_at)`` lines with its ``kind``.

    A line holds one frame or an array of them. Kinds: ``item``, ``control``,
    ``error`` (the feed's own), ``invalid`` (a news frame lacking a field) and
    ``unreadable`` (not JSON).
    """
    text = F.trim("value")
    wrapped = F.when(F.startswith(text, F.lit("[")), text).otherwise(
        F.concat(F.lit("["), text, F.lit("]")))
    parsed = lines.select("received_at", F.explode_outer(
        F.from_json(wrapped, f"array<{_FRAME}>")).alias("f"))
    created = F.try_to_timestamp(F.col("f.created_at"))
    complete = (
        F.col("f.id").isNotNull() & created.isNotNull()
        & (F.coalesce(F.col("f.headline"), F.lit("")) != "")
    )
    kind = (
        F.when(F.coalesce(F.col("f.T"), F.lit("")) == "", F.when(
            F.col("f.id").isNull() & F.col("f.headline").isNull() & F.col("f.msg").isNull(),
            "unreadable").otherwise("control"))
        .when(F.col("f.T") == "error", "error")
        .when(F.col("f.T") != "n", "control")
        .when(complete, "item").otherwise("invalid")
    )
    return parsed.select(kind.alias("kind"), "received_at", "f.*", created.alias("_created"))


def news_items(frames: DataFrame, default_source: str = "wire") -> DataFrame:
    """Valid news frames as articles with upper-cased symbols."""
    symbols = F.transform(
        F.filter(F.coalesce("symbols", F.array().cast("array<string>")),
                 lambda s: s.isNotNull() & (s != "")), F.upper)
    return frames.where(F.col("kind") == "item").select(
        F.col("id").alias("news_id"), symbols.alias("symbols"), "headline",
        F.coalesce(F.nullif("source", F.lit("")), F.lit(default_source)).alias("news_source"),
        "url", F.col("_created").alias("created_at"),
        F.try_to_timestamp("updated_at").alias("updated_at"), "received_at")


def _complete_story() -> Column:
    return (
        F.col("i.id").isNotNull() & (F.coalesce(F.col("i.headline"), F.lit("")) != "")
        & (F.coalesce(F.col("i.datetime"), F.lit(0)) != 0)
    )


def second_feed_counts(lines: DataFrame) -> DataFrame:
    """Records of the other feed, and those :func:`second_feed_items` leaves out."""
    item = F.from_json("value", "id string, headline string, datetime bigint")
    return lines.select(item.alias("i")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~_complete_story()).alias("left_out"))


def second_feed_items(lines: DataFrame, feed: str) -> DataFrame:
    """Company-news records of another feed in the shared shape.

    Lines are ``(ticker, received_at, value)``; ids and sources get the feed's
    name as a prefix so that the two feeds cannot collide.
    """
    item = F.from_json(
        "value", "id string, headline string, datetime bigint, source string, url string")
    rows = lines.select("ticker", "received_at", item.alias("i"))
    return rows.where(_complete_story()).select(
        F.concat(F.lit(f"{feed}:"), F.col("i.id")).alias("news_id"),
        F.array(F.upper("ticker")).alias("symbols"), F.col("i.headline").alias("headline"),
        F.concat(F.lit(f"{feed}:"), F.coalesce(F.col("i.source"), F.lit("unknown")))
        .alias("news_source"),
        F.col("i.url").alias("url"),
        F.timestamp_seconds(F.col("i.datetime")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"), "received_at")


# --- corporate actions -----------------------------------------------------

_ACTION = (
    "struct<symbol:string,old_symbol:string,new_symbol:string,ex_date:string,"
    "process_date:string,effective_date:string,old_rate:double,new_rate:double>"
)


def action_records(lines: DataFrame) -> DataFrame:
    """Actions of ``{"corporate_actions": {kind: [..]}}`` payloads.

    ``valid`` is false without a usable date or any symbol. A kind outside the
    vocabulary keeps its own name.
    """
    payload = F.from_json("value", f"corporate_actions map<string,array<{_ACTION}>>")
    kinds = lines.select(F.explode(payload["corporate_actions"]).alias("kind", "records"))
    rows = kinds.select("kind", F.inline("records"))
    known = F.create_map(*[F.lit(x) for pair in ACTION_TYPES.items() for x in pair])
    blank = F.lit("")
    effective = F.coalesce(*[
        F.nullif(c, blank) for c in ("ex_date", "process_date", "effective_date")])
    symbol = F.coalesce(*[F.nullif(c, blank) for c in ("symbol", "new_symbol", "old_symbol")])
    day = effective.try_cast("date")
    return rows.select(
        F.upper(symbol).alias("ticker"), day.alias("effective_date"),
        F.coalesce(F.try_element_at(known, F.col("kind")), F.col("kind")).alias("action_type"),
        F.try_divide("new_rate", "old_rate").alias("ratio"), "old_symbol", "new_symbol",
        (day.isNotNull() & symbol.isNotNull()).alias("valid"))


def valid_actions(records: DataFrame) -> DataFrame:
    return records.where("valid").drop("valid")


def action_rows(actions: DataFrame, day: Column, written_at: Column) -> DataFrame:
    """Rows of the ``corporate_actions`` table for one collection day."""
    return actions.select(
        "ticker", day.alias("date"), "effective_date", "action_type", "ratio", "old_symbol",
        "new_symbol", F.lit(None).cast("double").alias("cash_amount"),
        written_at.alias("written_at_utc"))


def in_collection_window(effective: Column, today: Column, back: int = 1, ahead: int = 5) -> Column:
    return effective.between(F.date_sub(today, back), F.date_add(today, ahead))
