"""Lake tables and feed readers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tapeloom import contracts
from tapeloom.config import RetentionRules
from tapeloom.operators import bars as bar_ops
from tapeloom.operators import news as news_ops
from tapeloom.operators import research as rs
from tapeloom.operators import retention as rt
from tapeloom.session import scratch_path
from tapeloom.sources import adapters as src
from tapeloom.sources import feeds, lake, landed
from tapeloom.suite.registry import et, query, r, t, with_

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def bar_table(spark, d):
    return feeds.bar_rows(src.bars(spark, d), now(), src.BAR_MINUTES)


def snapshot_table(spark, d):
    return src.snapshots(spark, d).select(
        "ticker", "date", F.col("poll_ts").alias("poll_ts_utc"), "price",
        F.col("volume").alias("session_volume"), "gap_pct", "rvol", now().alias("written_at_utc"))


def evaluation_table(spark, d):
    return src.day_evals(spark, d).select(
        "ticker", "date", F.col("poll_ts").alias("poll_ts_utc"),
        F.col("window_start").alias("window_start_utc"), "price", "gap_pct", "rvol",
        "float_shares", F.col("confidence").alias("float_confidence"),
        F.col("news_age").alias("news_age_minutes"),
        *[F.col(f"p{i}").alias(f"pillar_{i}_status") for i in range(1, 6)],
        F.col("passed").alias("pillars_passed"), F.col("unknown").alias("pillars_unknown"),
        "tier", now().alias("written_at_utc"))


def new_lake(spark, d, *tables):
    """A fresh lake holding the named tables."""
    root = scratch_path(spark, "lake")
    makers = {"bars_1m": bar_table, "snapshots": snapshot_table, "evaluations": evaluation_table,
              "news": lambda s, x: news_ops.news_rows(src.news(s, x))}
    for name in tables:
        lake.append(makers[name](spark, d), root, name, "suite")
    return root


BAR_COLS = f"""ticker, {t('date','date')}, {t('minute','minute_utc')}, {r('open','open')}, {r('high','high')},
    {r('low','low')}, {r('close','close')}, {r('volume','volume')}, trade_count, {r('vwap','vwap')},
    15::BIGINT AS resolution_minutes, '{NOW}' AS written_at_utc, 'suite' AS source, 1::BIGINT AS schema_version"""


@query("a1_read_day", with_("bars", f"SELECT {BAR_COLS} FROM bars WHERE date = DATE '2024-01-15'"))
def read_day(spark, d):
    """One partition, then an absent table read as empty with the same schema."""
    root = new_lake(spark, d, "bars_1m")
    nothing = lake.read_day(spark, scratch_path(spark, "empty"), "bars_1m", date(2024, 1, 15))
    return lake.read_day(spark, root, "bars_1m", date(2024, 1, 15)).unionByName(nothing)


@query("a2_lake_views", with_("bars polls", f"""SELECT {t('date','date')}, count(*) AS bars,
    (SELECT count(*) FROM polls p WHERE p.date=b.date) AS snapshots FROM bars b GROUP BY date"""))
def lake_views(spark, d):
    root = new_lake(spark, d, "bars_1m", "snapshots")
    lake.register_views(spark, root)
    return spark.sql("""SELECT b.date, b.n AS bars, coalesce(s.n, 0) AS snapshots
        FROM (SELECT date, count(*) AS n FROM bars_1m GROUP BY date) b
        LEFT JOIN (SELECT date, count(*) AS n FROM snapshots GROUP BY date) s USING (date)""")


@query("a3_append_with_provenance", with_("bars", f"SELECT {BAR_COLS} FROM bars"))
def append(spark, d):
    return lake.read_table(spark, new_lake(spark, d, "bars_1m"), "bars_1m")


@query("a4_contract_null_counts", with_("tagged", """SELECT 0::BIGINT AS news_id, 0::BIGINT AS date,
    0::BIGINT AS symbols, count(*) FILTER (event_id%19=0) AS headline, 0::BIGINT AS news_source,
    0::BIGINT AS created_at_utc, 0::BIGINT AS received_at_utc, 0::BIGINT AS written_at_utc FROM news"""))
def contract_null_counts(spark, d):
    """NULLs per required column; the writer itself refuses such rows."""
    rows = news_ops.news_rows(src.news(spark, d)).withColumn(
        "headline", F.when(F.col("news_id").cast("long") % 19 != 0, F.col("headline")))
    return contracts.null_counts(rows, "news")


@query("a5_compaction", with_("bars", f"""SELECT {t('date','date')}, count(*) AS rows, 1::BIGINT AS files
    FROM bars GROUP BY date"""))
def compaction(spark, d):
    """Three appends per day become one file per day; counts are verified."""
    root = scratch_path(spark, "lake")
    rows = bar_table(spark, d)
    for session in ("pre", "regular", "post", None):
        inside = bar_ops.tg.session_of(F.col("minute_utc"))
        part = rows.where(inside.isNull() if session is None else inside == session)
        lake.append(part, root, "bars_1m", "suite")
    lake.compact(spark, root, "bars_1m")
    n_files = lake.files(spark, root, "bars_1m").groupBy("date").agg(F.count(F.lit(1)).alias("files"))
    return lake.row_counts(spark, root, "bars_1m").join(n_files, "date")


@query("a6_replace_partition", with_("bars", f"""SELECT {t('date','date')}, count(*) FILTER (date <> DATE '2024-01-15'
    OR minute < TIMESTAMP '2024-01-15 15:00:00') AS rows, {r('''sum(CASE WHEN date = DATE '2024-01-15' THEN
    CASE WHEN minute < TIMESTAMP '2024-01-15 15:00:00' THEN volume*2 END ELSE volume END)''','volume')}
    FROM bars WHERE date <> DATE '2024-01-16' GROUP BY date"""))
def replace_partition(spark, d):
    """One day is rewritten, one is emptied, all others stay as they were."""
    root = new_lake(spark, d, "bars_1m")
    rows = lake.read_table(spark, root, "bars_1m")
    days = [date(2024, 1, 15), date(2024, 1, 16)]
    changed = rows.where(F.col("date").isin(days)).where(F.col("minute_utc") < "2024-01-15 15:00:00").withColumn(
        "volume", F.col("volume") * 2)
    lake.rewrite_days(changed.where(F.col("date") == date(2024, 1, 15)), root, "bars_1m",
                      days, "suite")
    return lake.read_table(spark, root, "bars_1m").groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@query("a7_table_coverage", with_("bars polls news", f"""SELECT n AS table_name, coalesce(x.days,0) AS days,
    {t('first_day','first_day')}, {t('last_day','last_day')}, x.days IS NOT NULL AS has_bytes
    FROM (SELECT unnest([{', '.join(f"'{n}'" for n in sorted(contracts.TABLES))}]) AS n) LEFT JOIN (
      SELECT 'bars_1m' AS k, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM bars
      UNION ALL SELECT 'snapshots', count(DISTINCT date), min(date), max(date) FROM polls
      UNION ALL SELECT 'news', count(DISTINCT {et('created_at')}::DATE), min({et('created_at')}::DATE),
        max({et('created_at')}::DATE) FROM news) x ON x.k = n"""))
def table_coverage(spark, d):
    root = new_lake(spark, d, "bars_1m", "snapshots", "news")
    return lake.coverage(spark, root).select(
        "table_name", "days", "first_day", "last_day", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("a8_row_counts", with_("polls", f"SELECT {t('date','date')}, count(*) AS rows FROM polls GROUP BY date"))
def row_counts(spark, d):
    return lake.row_counts(spark, new_lake(spark, d, "snapshots"), "snapshots")


@query("a20_csv_round_trip", with_("daily", f"""SELECT ticker, {t('date','date')}, {r('close','close')} FROM daily"""))
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    lake.to_csv(src.daily(spark, d).select("ticker", "date", "close"), path)
    return spark.read.schema("ticker string, date date, close double").option("header", True).csv(path)


GUARD = """date < (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT date FROM day_evals)) WHERE i = floor(n*0.7::DOUBLE))"""


@query("a21_guarded_sql", with_("day_evals", f"""SELECT {t('date','date')}, tier, count(*) AS n FROM day_evals
    WHERE {GUARD} GROUP BY date, tier"""))
def guarded_sql(spark, d):
    """Ad-hoc SQL over the lake; held-back days are invisible."""
    root = new_lake(spark, d, "evaluations")
    return lake.run_sql(spark, root, "SELECT date, tier, count(*) AS n FROM evaluations GROUP BY 1, 2",
                        holdout="evaluations")


@query("f4_row_cap", with_("day_evals", f"""SELECT ticker, n FROM (SELECT ticker, count(*) AS n FROM day_evals
    GROUP BY 1) x ORDER BY n DESC, ticker LIMIT 25"""))
def row_cap(spark, d):
    root = new_lake(spark, d, "evaluations")
    return lake.run_sql(
        spark, root,
        "SELECT ticker, count(*) AS n FROM evaluations GROUP BY 1 ORDER BY n DESC, ticker", row_cap=25)


@query("a22_drop_old_days", with_("polls", f"""SELECT 'snapshots' AS table_name, {t('date','date')},
    count(*) AS rows_before, 0::BIGINT AS rows_after, (SELECT count(*) FROM polls WHERE date >= DATE '2024-01-16')
    AS rows_left FROM polls WHERE date < DATE '2024-01-16' GROUP BY date"""))
def drop_old_days(spark, d):
    root = new_lake(spark, d, "snapshots")
    cutoff = rt.snapshot_cutoff(F.lit("2024-01-31").cast("date"), RetentionRules(snapshots_months=0.5))
    dropped = lake.drop_days(spark, root, "snapshots", cutoff)
    left = lake.read_table(spark, root, "snapshots").agg(F.count(F.lit(1))).scalar()
    return dropped.withColumn("rows_left", left)


@query("a23_protected_tables", with_("bars polls news", f"""SELECT n AS table_name, n NOT IN ('snapshots','reference','bars_1m')
    AS protected, coalesce(rows,0) AS rows FROM (SELECT unnest([{', '.join(f"'{n}'" for n in sorted(contracts.TABLES))}]) AS n)
    LEFT JOIN (SELECT 'bars_1m' AS k, count(*) AS rows FROM bars UNION ALL SELECT 'news', count(*) FROM news) x ON x.k=n"""))
def protected_tables(spark, d):
    """Rows at stake per table, and whether a destructive step would be refused."""
    root = new_lake(spark, d, "bars_1m", "news")
    out = None
    for name in sorted(contracts.TABLES):
        try:
            contracts.refuse_protected(name)
            refused = False
        except contracts.Protected:
            refused = True
        one = lake.read_table(spark, root, name).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(refused).alias("protected"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("d37_size_warning", with_("bars polls evals", f"""SELECT {r('total/1073741824','total_gb')}, {r('1','limit_gb')},
    {r('total/1073741824','used_share')}, largest FROM (SELECT sum(b) AS total, string_agg(n, '|' ORDER BY b DESC)
      FILTER (rk <= 3) AS largest FROM (SELECT *, row_number() OVER (ORDER BY b DESC) AS rk FROM (
        SELECT 'bars_1m' AS n, count(*)*50000::BIGINT AS b FROM bars UNION ALL SELECT 'snapshots', count(*)*60000 FROM polls
        UNION ALL SELECT 'evaluations', count(*)*20000 FROM evals UNION ALL SELECT 'news', count(*)*1000 FROM events)))
    WHERE total >= 0.8::DOUBLE*1073741824"""))
def size_warning(spark, d):
    """Sizes from row counts at assumed bytes per row, so that they are exact."""
    sizes = rs.table_history({
        "bars_1m": src.bars(spark, d), "snapshots": src.polls(spark, d),
        "evaluations": src.evals(spark, d), "news": src.ticks(spark, d)})
    width = F.element_at(F.create_map(*[F.lit(x) for x in (
        "bars_1m", 50_000, "snapshots", 60_000, "evaluations", 20_000, "news", 1_000)]), F.col("table_name"))
    return lake.size_warning(sizes.withColumn("size_bytes", F.col("rows") * width), RetentionRules(max_lake_gb=1))


@query("g1_concatenated_parts", with_("bars", f"""SELECT ticker, count(*) AS n, {r('sum(volume)','volume')} FROM bars
    GROUP BY ticker"""))
def concatenated_parts(spark, d):
    """Several part files of one schema read as one table."""
    root = scratch_path(spark, "lake")
    rows = bar_table(spark, d)
    early = F.col("minute_utc") < "2024-01-10"
    lake.append(rows.where(early), root, "bars_1m", "first")
    lake.append(rows.where(~early), root, "bars_1m", "second")
    return lake.read_table(spark, root, "bars_1m").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


# --- scanner feed ----------------------------------------------------------

SCANNED = """SELECT event_id, event_id//50 AS page, upper(uticker) AS ticker,
    CASE WHEN event_id%3=0 THEN 'NYSE' WHEN event_id%17=0 THEN 'OTC' ELSE 'NASDAQ' END AS exchange,
    CASE WHEN event_id%11=0 THEN 'fund' WHEN event_id%13=0 THEN NULL ELSE 'stock' END AS kind,
    event_id%7=0 AS etf, event_id%97=0 AS bad, price, volume,
    CASE WHEN event_id%5<>0 THEN user_id*1000+500 END AS float_shares,
    min(ts) OVER (PARTITION BY event_id//50) AS poll_ts FROM ticks"""
STOCK = "(kind IS NULL OR kind='stock') AND NOT etf AND exchange IN ('NASDAQ','NYSE')"


def scanned(spark, d):
    return feeds.scanner_rows(feeds.scanner_records(landed.scanner_payloads(spark, d)))


@query("a9_scanner_rows", with_("ticks", f"""SELECT {t('poll_ts','poll_ts')}, ticker, exchange, kind AS instrument_type,
    CASE WHEN etf THEN 'ETF' ELSE 'common' END AS typespecs, {r('CASE WHEN NOT bad THEN price END','close')},
    {r('volume','volume')}, float_shares, CASE WHEN bad THEN 'close is not a number' END AS parse_error
    FROM scanned""", scanned=SCANNED))
def scanner_rows(spark, d):
    return scanned(spark, d).select(
        "poll_ts", "ticker", "exchange", "instrument_type", "typespecs", "close", "volume",
        "float_shares", "parse_error")


@query("b1_listed_common_stock", with_("ticks", f"""SELECT {t('poll_ts','poll_ts')}, ticker, exchange, {r('price','close')}
    FROM scanned WHERE NOT bad AND {STOCK}""", scanned=SCANNED))
def listed_common_stock(spark, d):
    return feeds.tradable(scanned(spark, d)).select("poll_ts", "ticker", "exchange", "close")


@query("g5_typespec_overlap", with_("ticks", """SELECT CASE WHEN etf THEN 'ETF' ELSE 'common' END AS typespecs, etf AS excluded,
    count(*) AS n FROM scanned GROUP BY 1, 2""", scanned=SCANNED))
def typespec_overlap(spark, d):
    from tapeloom.functions import rules
    banned = F.array(*[F.lit(x) for x in rules.EXCLUDED_TYPESPECS])
    hit = F.arrays_overlap(F.transform("typespecs", F.lower), banned)
    return scanned(spark, d).groupBy(
        F.concat_ws("|", "typespecs").alias("typespecs"), hit.alias("excluded")).agg(
        F.count(F.lit(1)).alias("n"))


@query("a11_poll_report", with_("ticks", f"""SELECT {t('poll_ts','poll_ts')}, count(*) AS total,
    count(*) FILTER (NOT bad AND {STOCK}) AS kept, count(*) FILTER (bad) AS unparsable,
    count(*) FILTER (NOT bad AND NOT ({STOCK})) AS excluded_non_stock,
    (any_value(page)%40=7)::BIGINT AS unreadable, CASE WHEN bool_or(bad) THEN 'close is not a number' ELSE '' END AS errors,
    bool_or(bad OR page%40=7) AS degraded FROM scanned GROUP BY poll_ts""", scanned=SCANNED))
def poll_report(spark, d):
    """Some payloads landed cut off: they are counted."""
    lines = landed.scanner_payloads(spark, d)
    return feeds.poll_report(feeds.scanner_rows(feeds.scanner_records(lines)), lines)


@query("a10_column_contract", with_("ticks", """SELECT 'sector|industry' AS missing, count(*) AS rows FROM ticks"""))
def column_contract(spark, d):
    """Two optional columns did not come back; an essential one would be fatal."""
    records = feeds.scanner_records(landed.scanner_payloads(spark, d)).drop("sector", "industry")
    missing = feeds.missing_columns(records.columns)
    return records.agg(F.count(F.lit(1)).alias("rows")).withColumn("missing", F.lit("|".join(missing)))


@query("b2_source_floor_and_cap", with_("ticks", f"""SELECT ticker, {r('price','close')}, {r('volume','volume')} FROM (
    SELECT * FROM scanned WHERE NOT bad AND price >= 20 ORDER BY volume DESC, ticker, poll_ts, price LIMIT 200)""",
    scanned=SCANNED))
def source_floor_and_cap(spark, d):
    """The request's own shape: floor, busiest first, cap."""
    return feeds.busiest_above(scanned(spark, d), 20, 200, ("ticker", "poll_ts", "close")).select(
        "ticker", "close", "volume")


# --- bars feed -------------------------------------------------------------

BROKEN = "hour(minute)%7=0 AND minute(minute)=0"


def landed_bars(spark, d):
    return feeds.bar_records(landed.bar_pages(spark, d))


@query("a12_bar_records", with_("bars", f"""SELECT upper(ticker) AS ticker, {t('minute','minute')}, {r('open','open')},
    {r('high','high')}, {r('low','low')}, {r('close','close')}, {r('volume','volume')}, {r('vwap','vwap')}, trade_count
    FROM bars WHERE NOT ({BROKEN})"""))
def bar_records(spark, d):
    return feeds.valid_bars(landed_bars(spark, d))


@query("a12_unparsable_bars", with_("bars", f"""SELECT upper(ticker) AS ticker, count(*) FILTER ({BROKEN}) AS unparsable,
    count(*) FILTER (NOT ({BROKEN})) AS kept FROM bars GROUP BY 1"""))
def unparsable_bars(spark, d):
    return landed_bars(spark, d).groupBy("ticker").agg(
        F.count_if(~F.col("valid")).alias("unparsable"), F.count_if("valid").alias("kept"))


@query("a12_unreadable_pages", with_("bars", """SELECT count(*)+count(*) FILTER (day(date)=3) AS payloads,
    count(*) FILTER (day(date)=3) AS unreadable FROM (SELECT DISTINCT ticker, date FROM bars)"""))
def unreadable_pages(spark, d):
    return feeds.payload_counts(landed.bar_pages(spark, d), "bars")


@query("a13_bar_lake_rows", with_("bars", f"""SELECT upper(ticker) AS ticker, {t('date','date')}, {t('minute','minute_utc')},
    {r('close','close')}, {r('volume','volume')}, 15::BIGINT AS resolution_minutes FROM bars WHERE NOT ({BROKEN})"""))
def bar_lake_rows(spark, d):
    rows = feeds.bar_rows(feeds.valid_bars(landed_bars(spark, d)), now(), src.BAR_MINUTES)
    return contracts.conform(lake.stamp(rows, "feed"), "bars_1m").select(
        "ticker", "date", "minute_utc", "close", "volume", "resolution_minutes")


@query("c15_requested_minus_returned", with_("ticks", """SELECT DISTINCT uticker AS ticker FROM ticks
    WHERE uticker NOT IN (SELECT uticker FROM ticks WHERE volume >= 99)"""))
def requested_minus_returned(spark, d):
    """Every user was requested; only heavy trades came back."""
    everyone = src.ticks(spark, d).select(F.col("uticker").alias("ticker"))
    back = src.ticks(spark, d).where(F.col("volume") >= 99).select(F.col("uticker").alias("ticker"))
    return feeds.missing_symbols(everyone, back)


# --- news feeds ------------------------------------------------------------

@query("a14_news_frames", with_("news", f"""SELECT event_id::VARCHAR AS news_id, symbols[1] AS symbols,
    headline, CASE WHEN event_id%2=0 THEN 'desk' ELSE 'wire' END AS news_source,
    {t('created_at','created_at')} FROM news WHERE event_id%19<>0"""))
def news_frames(spark, d):
    items = feeds.news_items(feeds.news_frames(landed.news_lines(spark, d)))
    return items.select("news_id", "symbols", "headline", "news_source", "created_at")


@query("a14_frame_kinds", with_("ticks", """SELECT kind, count(*) AS n FROM (SELECT CASE ticker WHEN 'error' THEN 'error'
    WHEN 'view' THEN 'control' WHEN 'click' THEN 'unreadable' ELSE CASE WHEN event_id%19=0 THEN 'invalid' ELSE 'item' END END
    AS kind FROM ticks WHERE ticker <> 'purchase' UNION ALL SELECT 'control' FROM ticks WHERE ticker='signup' AND event_id%2=1)
    GROUP BY 1"""))
def frame_kinds(spark, d):
    return feeds.news_frames(landed.news_lines(spark, d)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"))


@query("a16_second_feed", with_("purchases", f"""SELECT 'second:'||event_id AS news_id, ticker AS symbols,
    'story '||event_id AS headline, CASE WHEN event_id%2=0 THEN 'second:paper' ELSE 'second:unknown' END AS news_source,
    'u' AS url, {t("date_trunc('second', ts)",'created_at')} FROM purchases WHERE event_id%23<>0"""))
def second_feed(spark, d):
    items = feeds.second_feed_items(landed.second_feed_lines(spark, d), "second")
    return items.select("news_id", "symbols", "headline", "news_source", "url", "created_at")


@query("a16_second_feed_left_out", with_("purchases", """SELECT count(*) AS records,
    count(*) FILTER (event_id%23=0) AS left_out FROM purchases"""))
def second_feed_left_out(spark, d):
    return feeds.second_feed_counts(landed.second_feed_lines(spark, d))


# --- corporate actions feed ------------------------------------------------

LANDED = """SELECT a.*, CASE WHEN ratio IS NOT NULL THEN ticker ELSE new_symbol END AS shown, ticker[2:]::BIGINT AS k
    FROM actions a"""


def landed_actions(spark, d):
    return feeds.action_records(landed.action_payloads(spark, d))


@query("a17_action_records", with_("actions", f"""SELECT shown AS ticker, {t('effective_date','effective_date')}, action_type,
    {r('ratio','ratio')}, old_symbol, new_symbol FROM landed WHERE NOT (k%3=2 AND k%5=0)""", landed=LANDED))
def action_records(spark, d):
    return feeds.valid_actions(landed_actions(spark, d))


@query("a17_unreadable_payloads", with_("actions", """SELECT count(*)+count(*) FILTER (page=0) AS payloads,
    count(*) FILTER (page=0) AS unreadable FROM (SELECT DISTINCT action_type, k//50 AS page FROM landed)""", landed=LANDED))
def unreadable_payloads(spark, d):
    return feeds.payload_counts(landed.action_payloads(spark, d), "actions")


@query("a18_action_lake_rows", with_("actions", f"""SELECT shown AS ticker, '2000-01-03' AS date,
    {t('effective_date','effective_date')}, action_type, {r('ratio','ratio')}, NULL::DOUBLE AS cash_amount
    FROM landed WHERE NOT (k%3=2 AND k%5=0)""", landed=LANDED))
def action_lake_rows(spark, d):
    rows = feeds.action_rows(feeds.valid_actions(landed_actions(spark, d)),
                             F.lit("2000-01-03").cast("date"), now())
    return contracts.conform(lake.stamp(rows, "feed"), "corporate_actions").select(
        "ticker", "date", "effective_date", "action_type", "ratio", "cash_amount")
