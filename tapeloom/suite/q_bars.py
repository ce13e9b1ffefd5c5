"""Time grid, bars, rollups and move metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import ALERT_WINDOWS, DISPLAY_TZ, MARKET_TZ
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators import bars as ops
from tapeloom.operators import calendar as cal
from tapeloom.sources import adapters as src
from tapeloom.suite.registry import SESSION, et, et_instant, mins, pct, query, r, sod, t, with_

MOVE_SQL = with_("moves", f"""SELECT ticker, {t('date','date')}, {r('up_move_pct','up_move_pct')},
    {r('down_move_pct','down_move_pct')}, {r('range_pct','range_pct')},
    {r('max_runup_pct','max_runup_pct')}, {r('max_drawdown_pct','max_drawdown_pct')},
    {r('fade_pct','fade_pct')},
    {r(mins(et_instant('date','04:00'),'high_minute'),'minutes_to_high')},
    {r('day_high','day_high')}, {r('day_low','day_low')}, {r('session_close','session_close')},
    {r('dollar_volume','dollar_volume')}, {r('prev_close','prev_close')}, bar_count,
    coalesce(up_move_pct >= 25, false) OR coalesce(max_runup_pct >= 25, false)
      OR coalesce(down_move_pct <= -25, false) AS is_mover FROM moves""")


@query("d3_move_metrics", MOVE_SQL)
def move_metrics(spark, d):
    """Flagship: the shape of every ticker-day, and whether it was a mover."""
    out = ops.move_metrics(src.bars(spark, d), src.daily(spark, d)).drop("pre_to_post_pct")
    return out.withColumn("is_mover", rules.is_mover(
        F.col("up_move_pct"), F.col("max_runup_pct"), F.col("down_move_pct"), 25.0))


@query("d3_move_metrics_as_of", with_("bars", f"""SELECT ticker, {t('date','date')},
    {r('max(high)','day_high')}, {r('min(low)','day_low')},
    {r('arg_max(close, minute)','session_close')}, {r('sum(close*volume)','dollar_volume')},
    {r('max(run)','max_runup_pct')}, count(*) AS bar_count
    FROM (SELECT *, {pct('high','lo')} AS run FROM (SELECT *, min(low) OVER (PARTITION BY ticker, date
      ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo
      FROM bars WHERE minute <= {et_instant('date','11:00')})) GROUP BY ticker, date"""))
def move_metrics_as_of(spark, d):
    """The same metrics with nothing after 11:00 visible."""
    return ops.move_metrics(src.bars(spark, d), as_of="11:00").select(
        "ticker", "date", "day_high", "day_low", "session_close", "dollar_volume",
        "max_runup_pct", "bar_count")


@query("d1_session_rollup", with_("sessions", f"""SELECT ticker, {t('date','date')}, session,
    {r('open','open')}, {r('high','high')}, {r('low','low')}, {r('close','close')},
    {r('volume','volume')}, {r('vwap','vwap')}, bar_count FROM sessions"""))
def session_rollup(spark, d):
    return ops.session_rollup(src.bars(spark, d))


@query("d2_dense_rollup", with_("sessions bars", f"""SELECT g.ticker, {t('g.date','date')}, g.session,
    {r('open','open')}, {r('high','high')}, {r('low','low')}, {r('close','close')},
    {r('coalesce(volume,0)','volume')}, {r('vwap','vwap')}, coalesce(bar_count,0) AS bar_count
    FROM (SELECT ticker, date, unnest(['pre','regular','post']) AS session
          FROM (SELECT DISTINCT ticker, date FROM bars)) g
    LEFT JOIN sessions s ON s.ticker=g.ticker AND s.date=g.date AND s.session=g.session"""))
def dense_rollup(spark, d):
    return ops.dense_rollup(src.bars(spark, d))


@query("d4_session_dollar_volume", with_("bars", f"""SELECT ticker, {t('date','date')},
    {r('sum(close*volume)','dollar_volume')} FROM bars GROUP BY ticker, date"""))
def session_dollar_volume(spark, d):
    return src.bars(spark, d).groupBy("ticker", "date").agg(
        F.sum(m.dollar_volume(F.col("close"), F.col("volume"))).alias("dollar_volume"))


@query("d5_thin_bars", with_("bars", f"""SELECT ticker, {t('date','date')},
    {t("time_bucket(INTERVAL 30 MINUTE, minute)",'minute')},
    {r('arg_min(open,minute)','open')}, {r('max(high)','high')}, {r('min(low)','low')},
    {r('arg_max(close,minute)','close')}, {r('sum(volume)','volume')},
    nullif(sum(trade_count),0)::BIGINT AS trade_count, NULL::DOUBLE AS vwap,
    30::BIGINT AS resolution_minutes
    FROM bars GROUP BY ticker, date, time_bucket(INTERVAL 30 MINUTE, minute)"""))
def thin_bars(spark, d):
    return ops.thin_bars(src.bars(spark, d), 30)


PATH_SQL = with_("paths", f"""SELECT ticker, {t('date','date')}, {t('minute','minute')},
    {r('low_so_far','low_so_far')}, {r('runup_pct','runup_pct')} FROM paths""")


@query("e1_runup_path", PATH_SQL)
def runup_path(spark, d):
    return ops.path_extremes(src.bars(spark, d)).select(
        "ticker", "date", "minute", "low_so_far", "runup_pct")


@query("e2_drawdown_path", with_("paths", f"""SELECT ticker, {t('date','date')},
    {t('minute','minute')}, {r('high_so_far','high_so_far')}, {r('drawdown_pct','drawdown_pct')}
    FROM paths"""))
def drawdown_path(spark, d):
    return ops.path_extremes(src.bars(spark, d)).select(
        "ticker", "date", "minute", "high_so_far", "drawdown_pct")


@query("e19_first_high", with_("moves", f"""SELECT ticker, {t('date','date')},
    {t('high_minute','high_minute')}, {r('day_high','day_high')} FROM moves"""))
def first_high(spark, d):
    return src.bars(spark, d).groupBy("ticker", "date").agg(
        F.min_by("minute", F.struct(-F.col("high"), F.col("minute"))).alias("high_minute"),
        F.max("high").alias("day_high"))


@query("h11_shape_percentages", with_("moves sessions", f"""SELECT m.ticker, {t('m.date','date')},
    {r('range_pct','range_pct')}, {r('fade_pct','fade_pct')}, {r(pct('q.close','p.open'),'pre_to_post_pct')}
    FROM moves m LEFT JOIN sessions p ON p.ticker=m.ticker AND p.date=m.date AND p.session='pre'
    LEFT JOIN sessions q ON q.ticker=m.ticker AND q.date=m.date AND q.session='post'"""))
def shape_percentages(spark, d):
    bars = src.bars(spark, d)
    rolled = ops.session_rollup(bars)
    edges = rolled.groupBy("ticker", "date").agg(
        F.max(F.when(F.col("session") == "pre", F.col("open"))).alias("pre_open"),
        F.max(F.when(F.col("session") == "post", F.col("close"))).alias("post_close"))
    return ops.move_metrics(bars, src.daily(spark, d), edges=edges).select(
        "ticker", "date", "range_pct", "fade_pct", "pre_to_post_pct")


@query("b19_session_attribution", with_("ticks", f"""SELECT coalesce(session,'outside') AS session,
    count(*) AS n, {r('sum(volume)','volume')} FROM (SELECT volume, {SESSION('ts')} AS session FROM ticks)
    GROUP BY 1"""))
def session_attribution(spark, d):
    tagged = src.ticks(spark, d).withColumn(
        "session", F.coalesce(tg.session_of(F.col("ts")), F.lit("outside")))
    return tagged.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


_WIN = " ".join(
    f"WHEN {sod('ts')} >= {tg.seconds_of(a)} AND {sod('ts')} < {tg.seconds_of(b)} THEN '{a}'"
    for a, b in ALERT_WINDOWS)


@query("b20_alert_window", with_("ticks", f"""SELECT event_id, {t('ts','ts')},
    strftime({et('ts')}, '%Y-%m-%d ') || w AS window_start_et
    FROM (SELECT *, CASE {_WIN} END AS w FROM ticks) WHERE w IS NOT NULL"""))
def alert_window(spark, d):
    ticks = src.ticks(spark, d).where(tg.in_any_window(F.col("ts"), ALERT_WINDOWS))
    start = tg.window_start(F.col("ts"), ALERT_WINDOWS)
    return ticks.select("event_id", "ts", F.date_format(tg.et(start), "yyyy-MM-dd HH:mm")
                        .alias("window_start_et"))


@query("b31_delayed_feed_clamp", with_("ticks", f"""SELECT ticker, count(*) AS n, {t('max(ts)','last_ts')}
    FROM ticks WHERE ts <= (SELECT max(ts) FROM ticks) - INTERVAL 15 MINUTE GROUP BY ticker"""))
def delayed_feed_clamp(spark, d):
    """Only what a 15-minute-delayed feed may show at the last instant."""
    ticks = src.ticks(spark, d)
    now = ticks.agg(F.max("ts").alias("now")).scalar()
    end = tg.visible_until(now, now, 15)
    return ticks.where(F.col("ts") <= end).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("h8_clock_arithmetic", with_("ticks", f"""SELECT event_id, {t('date','et_date')},
    {t(et('ts'),'et_wall')}, (epoch_us(ts) - epoch_us({et_instant('date','04:00')}))::BIGINT AS micros_since_open FROM ticks"""))
def clock_arithmetic(spark, d):
    ts = F.col("ts")
    return src.ticks(spark, d).select(
        "event_id", tg.et_date(ts).alias("et_date"), tg.et(ts).alias("et_wall"),
        F.round(tg.minutes_since(ts) * 60_000_000).cast("long").alias("micros_since_open"))


@query("h9_minute_grid", with_("ticks", f"""SELECT ticker, {t('minute','minute')} FROM (
    SELECT ticker, unnest(generate_series(date_trunc('minute', lo),
        date_trunc('minute', hi) - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute
    FROM (SELECT ticker, date_trunc('hour', ts) AS h, min(ts) AS lo, max(ts) AS hi
          FROM ticks GROUP BY ALL))"""))
def minute_grid(spark, d):
    """Every minute mark between the first and last trade of an hour."""
    spans = src.ticks(spark, d).groupBy("ticker", F.date_trunc("hour", F.col("ts")).alias("h")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return spans.select("ticker", F.explode(tg.minute_marks(F.col("lo"), F.col("hi"))).alias("minute"))


@query("h10_minute_offset", with_("ticks", f"""SELECT minute_offset, count(*) AS n FROM (SELECT
    greatest(0, floor({mins(et_instant('date','04:00'),'ts')}))::BIGINT AS minute_offset FROM ticks)
    GROUP BY 1"""))
def minute_offset(spark, d):
    return src.ticks(spark, d).groupBy(tg.minute_offset(F.col("ts")).alias("minute_offset")).agg(
        F.count(F.lit(1)).alias("n"))


@query("h23_two_clocks", with_("ticks", f"""SELECT event_id,
    strftime({et('ts')}, '%H:%M:%S') || ' ET' AS market_clock,
    strftime(timezone('Europe/Paris', timezone('UTC', ts)), '%H:%M') AS display_clock FROM ticks"""))
def two_clocks(spark, d):
    return src.ticks(spark, d).select(
        "event_id",
        F.concat(tg.wall_text(F.col("ts"), MARKET_TZ, "HH:mm:ss"), F.lit(" ET")).alias("market_clock"),
        tg.wall_text(F.col("ts"), DISPLAY_TZ).alias("display_clock"))


@query("b30_trading_day_filter", with_("ticks calendar", f"""SELECT {t('t.date','date')}, count(*) AS n
    FROM ticks t WHERE date IN (SELECT date FROM calendar)
      AND {sod('ts')} >= 34200 AND {sod('ts')} < CASE WHEN dayofweek(date)=5 THEN 46800 ELSE 57600 END
    GROUP BY 1"""))
def trading_day_filter(spark, d):
    """Regular hours of trading days only; Fridays close early at 13:00 here."""
    days = cal.with_hours(src.calendar(spark, d), early_close=F.dayofweek("date") == 6)
    return cal.during_regular_hours(src.ticks(spark, d), days).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"))


@query("e13_nth_next_trading_day", with_("daily calendar", f"""SELECT ticker, {t('date','run_date')},
    {t('''coalesce((SELECT c.date FROM calendar c WHERE c.ord = d.ord_le + 5),
        greatest(date, (SELECT max(date) FROM calendar)))''','expires_on')}
    FROM (SELECT ticker, date, (SELECT count(*) FROM calendar c WHERE c.date <= daily.date) AS ord_le
          FROM daily) d"""))
def nth_next_trading_day(spark, d):
    return cal.expiry(src.daily(spark, d).select("ticker", F.col("date").alias("run_date")),
                      src.calendar(spark, d), "run_date", 5).select(
        "ticker", "run_date", "expires_on")


@query("e14_previous_trading_days", with_("calendar", f"""SELECT {t('a.date','day')},
    {t('b.date','previous_day')} FROM calendar a JOIN calendar b
    ON b.ord BETWEEN a.ord-10 AND a.ord-1"""))
def previous_trading_days(spark, d):
    return cal.previous_days(src.calendar(spark, d), 10)


_WINDOWS = ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in ALERT_WINDOWS)
_OPEN = f"""SELECT day, w.a AS wall, timezone('UTC', timezone('America/New_York', day + w.a::TIME)) AS starts_at,
    timezone('UTC', timezone('America/New_York', day + w.b::TIME)) AS ends_at FROM (
      SELECT date AS day, unnest([{_WINDOWS}]) AS w FROM calendar)
    WHERE NOT (dayofweek(day)=5 AND w.a >= '13:00')"""


@query("h20_next_windows", with_("calendar", f"""SELECT {t('day','day')}, wall, {t('starts_at','starts_at')},
    {t('ends_at','ends_at')} FROM opened WHERE starts_at > TIMESTAMP '2024-01-11 21:10:00'
    ORDER BY opened.starts_at LIMIT 9""", opened=_OPEN))
def next_windows(spark, d):
    """The next nine alert windows; Fridays are half days here."""
    at = F.lit("2024-01-11 21:10:00").cast("timestamp")
    hours = cal.with_hours(src.calendar(spark, d), early_close=F.dayofweek("date") == 6)
    return cal.next_windows(hours, ALERT_WINDOWS, at, 9)


@query("h23_window_text", with_("calendar", f"""SELECT {t('starts_at','starts_at')},
    strftime({et('starts_at')}, '%a %d %b %H:%M')||'-'||strftime({et('ends_at')}, '%H:%M')||' ET ('||
    strftime(timezone('Europe/Paris', timezone('UTC', starts_at)), '%H:%M')||' Europe/Paris)' AS line
    FROM opened""", opened=_OPEN))
def window_text(spark, d):
    hours = cal.with_hours(src.calendar(spark, d), early_close=F.dayofweek("date") == 6)
    return cal.windows_of(hours, ALERT_WINDOWS).select(
        "starts_at", cal.window_text(F.col("starts_at"), F.col("ends_at")).alias("line"))


@query("i2_window_scope", with_("ticks", f"""SELECT w AS window_wall, {t('date','date')}, count(*) AS n,
    {r('max(price)','high')} FROM (SELECT *, CASE {_WIN} END AS w FROM ticks)
    WHERE w IS NOT NULL GROUP BY w, date"""))
def window_scope(spark, d):
    """Trades keyed by the wall-clock window they fall in."""
    start = tg.window_start(F.col("ts"), ALERT_WINDOWS)
    return (src.ticks(spark, d).withColumn("window_start", start)
            .where(F.col("window_start").isNotNull())
            .groupBy(tg.wall_text(F.col("window_start"), MARKET_TZ).alias("window_wall"), "date")
            .agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high")))
