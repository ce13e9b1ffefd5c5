"""News: visibility at a moment, freshness, de-duplication and feed health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators.scan import asof_join, running


def by_symbol(news: DataFrame) -> DataFrame:
    """One row per article and distinct upper-cased symbol."""
    symbols = F.array_distinct(F.transform("symbols", F.upper))
    return news.withColumn("ticker", F.explode(symbols)).drop("symbols")


def latest_news(
    probes: DataFrame,
    tagged: DataFrame,
    ts: str,
    payload: Sequence[str] = ("news_id", "headline", "created_at"),
    received_too: bool = False,
    chunk_unit: str = "hour",
) -> DataFrame:
    """Each probe with its ticker's newest article that existed at ``ts``.

    With ``received_too`` an article also has to have arrived by then, which
    is what a replay of the live system would have seen.
    """
    if not received_too:
        return asof_join(probes, tagged, ["ticker"], ts, "created_at", payload, ["news_id"],
                         chunk_unit, "news")
    rows = probes.select(
        "ticker", F.col(ts).alias("_at"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_row"),
    )
    item = F.struct(F.col("created_at").alias("_k1"), F.col("news_id").alias("_k2"),
                    F.struct(*payload).alias("item"))
    facts = tagged.select(
        "ticker", F.greatest("created_at", "received_at").alias("_at"), F.lit(0).alias("_side"),
        item.alias("_item"),
    )
    scanned = running(
        rows.unionByName(facts, allowMissingColumns=True), ["ticker"],
        F.date_trunc(chunk_unit, F.col("_at")), ["_at", "_side"],
        {"_newest": ("max", F.col("_item"))},
    )
    return scanned.where(F.col("_side") == 1).select("_row.*", F.col("_newest.item").alias("news"))


def with_freshness(probes: DataFrame, ts: str, fresh_minutes: int) -> DataFrame:
    """Freshness class and age of the article :func:`latest_news` attached."""
    created = F.col("news.created_at")
    return probes.withColumns({
        "freshness": rules.freshness(created, F.col(ts), fresh_minutes),
        "news_age": tg.minutes_between(created, F.col(ts)),
    })


def fresh_only(probes: DataFrame) -> DataFrame:
    """Drop the article, not the probe, where it is not fresh."""
    fresh = F.col("freshness") == "fresh"
    return probes.withColumns({
        "news": F.when(fresh, F.col("news")), "news_age": F.when(fresh, F.col("news_age")),
    })


def first_news(tagged: DataFrame) -> DataFrame:
    """Earliest article per ticker and market day."""
    return tagged.groupBy("ticker", tg.et_date(F.col("created_at")).alias("date")).agg(
        F.min("created_at").alias("first_news"),
        F.min_by("news_id", F.struct("created_at", "news_id")).alias("first_news_id"),
    )


def first_arrivals(*feeds: DataFrame) -> DataFrame:
    """Union of overlapping feeds, one row per article: the first to arrive."""
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed)
    rest = [c for c in merged.columns if c != "news_id"]
    picked = merged.groupBy("news_id").agg(
        F.min_by(F.struct(*rest), F.col("received_at")).alias("_row"))
    return picked.select("news_id", "_row.*")


def latency_seconds() -> Column:
    """Publication to receipt; negative values are kept."""
    return tg.seconds_between(F.col("created_at"), F.col("received_at"))


def news_rows(news: DataFrame) -> DataFrame:
    """Rows of the ``news`` table."""
    return news.select(
        "news_id", tg.et_date(F.col("created_at")).alias("date"), "symbols", "headline",
        "news_source", "url", F.col("created_at").alias("created_at_utc"),
        F.col("updated_at").alias("updated_at_utc"), F.col("received_at").alias("received_at_utc"),
        latency_seconds().alias("feed_latency_s"), F.col("received_at").alias("written_at_utc"),
    )


def outages(log: DataFrame, keys: Sequence[str], chunk_unit: str = "hour") -> DataFrame:
    """Outage intervals from a connection log ``(*keys, ts, event_id, state)``.

    An outage opens at the first ``down`` after anything else and closes at
    the next ``up``; one still open has a NULL end.
    """
    order = ["ts", "event_id"]
    chunk = F.date_trunc(chunk_unit, F.col("ts"))
    seen = running(log, keys, chunk, order, {"_prev": ("last", F.col("state"))},
                   include_current=False)
    opens = (F.col("state") == "down") & ~F.col("_prev").eqNullSafe(F.lit("down"))
    closes = (F.col("state") == "up") & F.col("_prev").eqNullSafe(F.lit("down"))
    marks = seen.select(*keys, *order, opens.alias("_opens"), closes.alias("_closes")).where(
        "_opens or _closes")
    paired = running(marks, keys, chunk, order,
                     {"started": ("last", F.when(F.col("_opens"), F.col("ts")))})
    closed = paired.where("_closes").select(*keys, "started", F.col("ts").alias("ended"))
    still = marks.groupBy(*keys).agg(F.max_by(F.struct("_opens", "ts"), F.struct(*order)).alias("m"))
    pending = still.where("m._opens").select(
        *keys, F.col("m.ts").alias("started"), F.lit(None).cast("timestamp").alias("ended"))
    return closed.unionByName(pending)


def outage_minutes(intervals: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Total minutes and reconnects; an open outage counts up to ``as_of``."""
    length = F.unix_micros(F.coalesce("ended", as_of)) - F.unix_micros("started")
    return intervals.groupBy(*keys).agg(
        (F.sum(length) / F.lit(60_000_000.0)).alias("disconnect_minutes"),
        F.count("ended").alias("reconnects"),
    )


def source_status(successes: DataFrame, as_of: Column, stale_after_s: float) -> DataFrame:
    """Last success per source, its age, and whether that is healthy."""
    last = successes.groupBy("source").agg(F.max("ts").alias("last_success"))
    age = tg.seconds_between(F.col("last_success"), as_of)
    return last.withColumn("age_seconds", age).withColumn(
        "healthy", F.col("age_seconds") <= stale_after_s)
