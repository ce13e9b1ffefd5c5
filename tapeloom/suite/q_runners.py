"""Runner detection, diagnosis, watch-list and digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import PillarThresholds, RunnerRules
from tapeloom.functions import text
from tapeloom.operators import calendar as cal
from tapeloom.operators import evaluations as ev
from tapeloom.operators import news as news_ops
from tapeloom.operators import runners as ops
from tapeloom.operators.scan import places
from tapeloom.sources import adapters as src
from tapeloom.suite.q_rules import EVAL_ORDER
from tapeloom.suite.registry import et, et_instant, half_even, mins, pct, query, r, sod, t, with_

RULES = RunnerRules(intraday_lookback_minutes=60, min_dollar_volume=1000.0)

ROLLED = f"""SELECT *, {pct('high','rl')} AS move, CASE WHEN inw THEN {pct('high','wl')} END AS wmove FROM (
    SELECT *, min(low) OVER w AS rl, min(CASE WHEN inw THEN low END) OVER w AS wl FROM (SELECT *,
      minute >= {et_instant('date','04:00')} AND minute < {et_instant('date','11:00')} AS inw FROM {{bars}})
    WINDOW w AS (PARTITION BY ticker, date ORDER BY minute RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW))"""


@query("e3_rolling_move", with_("bars", f"""SELECT ticker, {t('date','date')},
    {r('CASE WHEN count(*) FILTER (inw) >= 2 THEN max(wmove) END','intraday_move_pct')} FROM rolled
    GROUP BY ticker, date""", rolled=ROLLED.format(bars="bars")))
def rolling_move(spark, d):
    return ops.intraday_moves(src.bars(spark, d), RULES).select("ticker", "date", "intraday_move_pct")


@query("e4_move_start", with_("bars", f"""SELECT ticker, {t('date','date')},
    {t('min(minute) FILTER (move >= 10)','move_start')} FROM rolled GROUP BY ticker, date""",
    rolled=ROLLED.format(bars="bars")))
def move_start(spark, d):
    return ops.intraday_moves(src.bars(spark, d), RULES).select("ticker", "date", "move_start")


@query("e5_price_at_move_start", with_("bars", f"""SELECT ticker, {t('date','date')},
    {r('arg_min(close, minute) FILTER (move >= 10)','price')} FROM rolled GROUP BY ticker, date""",
    rolled=ROLLED.format(bars="bars")))
def price_at_move_start(spark, d):
    return ops.intraday_moves(src.bars(spark, d), RULES).select(
        "ticker", "date", F.col("price_at_move_start").alias("price"))


DETECTED = f"""SELECT *, CASE WHEN NOT floor THEN high_pct END AS shown_high,
    CASE WHEN floor THEN 'BELOW_FLOORS'
      WHEN high_pct >= 50 THEN 'DAY_HIGH:'||{half_even('high_pct',0)}
      WHEN intraday >= 30 THEN 'INTRADAY:'||{half_even('intraday',0)}
      WHEN post >= 30 THEN 'POST_MARKET:'||{half_even('post',0)}
      ELSE 'NONE' END AS rule,
    NOT floor AND (coalesce(high_pct >= 50,false) OR coalesce(intraday >= 30,false)
      OR coalesce(post >= 30,false)) AS is_runner FROM (SELECT a.*, {pct('day_high','prev_close')} AS high_pct,
      {pct('post_high','four_price')} AS post, last_price < 1 OR dollars < 1000 AS floor FROM (
        SELECT ticker, date, CASE WHEN count(*) FILTER (inw) >= 2 THEN max(wmove) END AS intraday,
        min(minute) FILTER (move >= 10) AS start, arg_min(close, minute) FILTER (move >= 10) AS start_price,
        arg_max(close, minute) AS last_price, sum(close*volume) AS dollars, max(high) AS day_high,
        max(high) FILTER (minute >= {et_instant('date','16:00')}) AS post_high,
        arg_max(close, minute) FILTER (minute <= {et_instant('date','16:00')}) AS four_price
        FROM rolled GROUP BY ticker, date) a LEFT JOIN udaily y ON y.ticker=a.ticker AND y.date=a.date)"""
ROLLED_U = ROLLED.format(bars="ubars")


def detected(spark, d):
    return ops.detect(src.user_bars(spark, d), src.user_daily(spark, d), RULES)


@query("l1_runner_detection", with_("ubars udaily", f"""SELECT ticker, {t('date','date')}, is_runner, rule,
    {r('shown_high','high_of_day_pct')}, {t('CASE WHEN is_runner THEN start END','move_start')},
    {r('CASE WHEN is_runner THEN start_price END','price_at_move_start')}, {r('dollars','dollar_volume')}
    FROM detected""", rolled=ROLLED_U, detected=DETECTED))
def runner_detection(spark, d):
    return detected(spark, d)


FIRST = f"""SELECT ticker, {et('created_at')}::DATE AS date, min(created_at) AS first_news FROM tagged
    GROUP BY 1, 2"""
SUMMARY = """SELECT s.*, b.best, b.best_ts FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date
      ORDER BY poll_ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS rn
      FROM day_evals) s JOIN (SELECT ticker, date, ['none','watch','B','A'][max(k)+1] AS best,
      arg_min(poll_ts, (-k, poll_ts)) AS best_ts FROM day_evals GROUP BY 1,2) b
    ON b.ticker=s.ticker AND b.date=s.date WHERE rn=1"""
_IN = " OR ".join(f"({sod('start')} >= {a} AND {sod('start')} < {a + 300})"
                  for a in (28800, 30600, 32400, 57600, 59400))


def _compact(x):
    return (f"CASE WHEN {x} IS NULL THEN '?' WHEN abs({x}) >= 1000000 THEN "
            f"{half_even(f'({x})/1000000', 1)}||'M' ELSE {half_even(x, 2)} END")


def _pillar_sql(n, value, threshold):
    status = f"p{n}"
    fail = f"{status}='fail'" if n != 3 else "false"
    near = f"{fail} AND abs({value}-{threshold})/{threshold}::DOUBLE <= 0.2::DOUBLE"
    reasons = [f"CASE WHEN {status}='unknown' THEN 'DATA_MISSING' END",
               f"CASE WHEN {fail} THEN 'FAILED_PILLAR' END", f"CASE WHEN {near} THEN 'NEAR_MISS' END"]
    details = [f"CASE WHEN {status}='unknown' THEN 'p{n}?' END",
               f"CASE WHEN {fail} THEN 'p{n}='||{_compact(f'{value}::DOUBLE')}||'/'||"
               f"{_compact(f'{threshold}::DOUBLE')} END",
               f"CASE WHEN {near} THEN 'p{n}~0.2' END"]
    return reasons, details


_R, _D = [], []
for _args in ((1, "gap_pct", 10), (2, "rvol", 5), (3, "news_age", 15), (4, "price", 20),
              (5, "float_shares", 20000000)):
    _a, _b = _pillar_sql(*_args)
    _R += _a
    _D += _b
DIAGNOSED = f"""SELECT *, CASE WHEN caught THEN 'CAUGHT' ELSE array_to_string([reasons[i] for i in range(1, len(reasons)+1)
      if reasons[i] IS NOT NULL AND list_position(reasons, reasons[i]) = i], '|') END AS miss_reasons,
    CASE WHEN caught THEN 'tier='||best_tier ELSE array_to_string([
      CASE WHEN NOT evaluated THEN 'not_collected' END,
      CASE WHEN outside THEN 'started='||strftime({et('start')},'%H:%M') END,
      {', '.join(_D)}, CASE WHEN lag > 15 THEN 'news=+'||{half_even('lag',0)} WHEN lag < -15 THEN 'news='||{half_even('lag',0)} END], '; ') END AS miss_detail FROM (SELECT *, [
        CASE WHEN NOT evaluated THEN 'NOT_IN_UNIVERSE' END, CASE WHEN outside THEN 'OUTSIDE_WINDOW' END, {', '.join(_R)},
        CASE WHEN first_news IS NULL THEN 'NO_NEWS' WHEN lag > 15 THEN 'NEWS_LATE' WHEN lag < -15 THEN 'NEWS_STALE' END]
        AS reasons FROM (SELECT e.ticker, e.date, e.start, e.rule, e.shown_high, e.start_price, e.dollars,
          coalesce(s.best,'none') AS best_tier, s.best_ts, s.l_orderkey IS NOT NULL AS evaluated,
          coalesce(s.best IN ('A','B'), false) AS caught, n.first_news,
          {mins('e.start','n.first_news')} AS lag, s.p1, s.p2, s.p3, s.p4, s.p5, s.gap_pct, s.rvol, s.news_age,
          s.price, s.float_shares, coalesce(NOT ({_IN.replace('start', 'e.start')}), false) AS outside
        FROM (SELECT * FROM detected WHERE is_runner) e
        LEFT JOIN summary s ON s.ticker=e.ticker AND s.date=e.date
        LEFT JOIN firsts n ON n.ticker=e.ticker AND n.date=e.date))"""
PARTS = dict(rolled=ROLLED_U, detected=DETECTED, firsts=FIRST, summary=SUMMARY, diagnosed=DIAGNOSED)
DEPS = "ubars udaily tagged day_evals"


def summaries(spark, d):
    return ev.evaluation_summary(src.day_evals(spark, d), PillarThresholds(), EVAL_ORDER)


def diagnosed(spark, d, verdicts=None):
    """From stored summaries where they are given."""
    verdicts = summaries(spark, d) if verdicts is None else verdicts
    firsts = news_ops.first_news(news_ops.by_symbol(src.news(spark, d)))
    return ops.diagnose(detected(spark, d), verdicts, firsts, RULES)


def runner_table(spark, d, verdicts=None):
    return ops.runner_rows(diagnosed(spark, d, verdicts), F.lit("2024-02-01").cast("timestamp"))


@query("l2_miss_diagnosis", with_(DEPS, f"""SELECT ticker, {t('date','date')}, caught, miss_reasons, miss_detail
    FROM diagnosed""", **PARTS))
def miss_diagnosis(spark, d):
    return diagnosed(spark, d).select("ticker", "date", "caught", "miss_reasons", "miss_detail")


@query("h17_reason_text", with_(DEPS, """SELECT miss_reasons, count(*) AS n, min(miss_detail) AS sample
    FROM diagnosed GROUP BY 1""", **PARTS))
def reason_text(spark, d):
    return diagnosed(spark, d).groupBy(F.concat_ws("|", "miss_reasons").alias("miss_reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.min("miss_detail").alias("sample"))


@query("g6_ordered_distinct_reasons", with_(DEPS, """SELECT miss_reasons, count(*) AS n FROM diagnosed
    WHERE NOT caught GROUP BY 1""", **PARTS))
def ordered_distinct_reasons(spark, d):
    """First occurrences keep their order."""
    rows = diagnosed(spark, d).where(~F.col("caught"))
    return rows.groupBy(F.array_join("miss_reasons", "|").alias("miss_reasons")).agg(
        F.count(F.lit(1)).alias("n"))


@query("l3_runner_rows", with_(DEPS, f"""SELECT ticker, {t('date','date')}, {r('shown_high','high_of_day_pct')},
    {t('start','move_start_utc')}, {t('first_news','first_news_utc')}, {r('lag','news_lag_minutes')}, best_tier,
    {t('best_ts','best_tier_ts_utc')}, {r('start_price','price_at_move_start')}, float_shares,
    {r('dollars','dollar_volume')}, miss_reasons, miss_detail, rule AS qualifying_rule,
    '2024-02-01 00:00:00' AS written_at_utc FROM diagnosed""", **PARTS))
def runner_rows(spark, d):
    return runner_table(spark, d)


@query("c25_diagnosis_inputs", with_(DEPS, f"""SELECT ticker, {t('date','date')}, evaluated, best_tier,
    {t('first_news','first_news')} FROM diagnosed""", **PARTS))
def diagnosis_inputs(spark, d):
    return diagnosed(spark, d).select("ticker", "date", "evaluated", "best_tier", "first_news")


@query("h12_news_lag", with_(DEPS, f"""SELECT ticker, {t('date','date')}, {r('lag','news_lag_minutes')}
    FROM diagnosed WHERE lag IS NOT NULL""", **PARTS))
def news_lag(spark, d):
    return diagnosed(spark, d).select("ticker", "date", "news_lag_minutes").where(
        F.col("news_lag_minutes").isNotNull())


@query("d25_miss_reason_counts", with_(DEPS, """SELECT reason, count(*) AS n FROM (SELECT
    unnest(string_split(miss_reasons,'|')) AS reason FROM diagnosed) GROUP BY 1""", **PARTS))
def miss_reason_counts(spark, d):
    return ops.reason_counts(runner_table(spark, d))


@query("d26_caught_by_day", with_(DEPS, f"""SELECT {t('date','date')}, count(*) FILTER (caught) AS caught,
    count(*) FILTER (NOT caught) AS missed FROM diagnosed GROUP BY date""", **PARTS))
def caught_by_day(spark, d):
    return ops.caught_by_day(runner_table(spark, d))


DIGEST = f"""SELECT {t('date','date')}, missed, missed||CASE WHEN missed=1 THEN ' runner' ELSE ' runners' END||
    ' missed today — top: '||top||' +'||{half_even('high',0)}||'%' AS line FROM (SELECT date,
    count(*) AS missed, arg_max(ticker, (coalesce(shown_high,0), ticker)) AS top,
    max(coalesce(shown_high,0)) AS high FROM diagnosed WHERE NOT caught GROUP BY date)"""


@query("d36_digest_line", with_(DEPS, DIGEST, **PARTS))
def digest_line(spark, d):
    return ops.digest(runner_table(spark, d))


@query("k9_daily_digest", with_(DEPS, DIGEST, **PARTS))
def daily_digest(spark, d):
    """The digest job: detect, diagnose, drop what was caught, one line per day."""
    return ops.digest(runner_table(spark, d))


@query("f5_runners_by_high", with_(DEPS, f"""SELECT {t('date','date')}, ticker, {r('coalesce(shown_high,0)','high')},
    row_number() OVER (PARTITION BY date ORDER BY coalesce(shown_high,0) DESC, ticker) AS place FROM diagnosed""",
    **PARTS))
def runners_by_high(spark, d):
    """Runners of a day, biggest first; an unknown high counts as zero."""
    high = F.coalesce("high_of_day_pct", F.lit(0.0))
    rows = runner_table(spark, d).select("date", "ticker", high.alias("high"))
    return places(rows, ["date"], F.col("high"), ["ticker"])


# --- watch-list ------------------------------------------------------------

EXPIRY = """coalesce((SELECT c.date FROM calendar c WHERE c.ord = (SELECT count(*) FROM calendar k
    WHERE k.date <= x.date) + 5), greatest(x.date, (SELECT max(date) FROM calendar)))"""
ENTRIES = f"""SELECT ticker, date AS run_date, coalesce(shown_high,0) AS high_pct, {EXPIRY} AS expires_on,
    date_part('day', date)=2 AS pinned FROM diagnosed x WHERE NOT caught"""
WATCH = dict(PARTS, entries=ENTRIES)
TODAY = "2024-01-19"


def watch_entries(spark, d):
    """Missed runners as watch-list entries; those of the 2nd are pinned."""
    missed = runner_table(spark, d).where(~F.array_contains("miss_reasons", "CAUGHT"))
    rows = missed.select(
        "ticker", F.col("date").alias("run_date"),
        F.coalesce("high_of_day_pct", F.lit(0.0)).alias("high_pct"),
        (F.dayofmonth("date") == 2).alias("pinned"))
    return cal.expiry(rows, src.calendar(spark, d), "run_date", 5).select(
        "ticker", "run_date", "high_pct", "expires_on", "pinned")


def today():
    return F.lit(TODAY).cast("date")


COLS = f"""ticker, {t('run_date','run_date')}, {r('high_pct','high_pct')}, {t('expires_on','expires_on')}, pinned"""


@query("f8_watchlist_active", with_(DEPS + " calendar", f"""SELECT {COLS} FROM entries
    WHERE pinned OR expires_on >= DATE '{TODAY}' ORDER BY entries.run_date DESC, entries.high_pct DESC""", **WATCH))
def watchlist_active(spark, d):
    return ops.watch_ordered(ops.watch_active(watch_entries(spark, d), today()))


@query("f9_watchlist_prune", with_(DEPS + " calendar", f"""SELECT pinned, count(*) AS kept,
    {t('min(expires_on)','first_expiry')} FROM entries WHERE pinned OR expires_on >= DATE '{TODAY}' GROUP BY 1""",
    **WATCH))
def watchlist_prune(spark, d):
    return ops.watch_pruned(watch_entries(spark, d), today()).groupBy("pinned").agg(
        F.count(F.lit(1)).alias("kept"), F.min("expires_on").alias("first_expiry"))


@query("f10_watchlist_upsert", with_(DEPS + " calendar", f"""SELECT {COLS} FROM (
    SELECT ticker, run_date, CASE WHEN high_pct >= 300 THEN high_pct*2 ELSE high_pct END AS high_pct,
    expires_on, pinned FROM entries)""", **WATCH))
def watchlist_upsert(spark, d):
    """Big entries arrive again with a doubled high and no pin; the pin stays."""
    stored = watch_entries(spark, d)
    again = stored.where(F.col("high_pct") >= 300).withColumns({
        "high_pct": F.col("high_pct") * 2, "pinned": F.lit(False)})
    return ops.watch_upsert(stored, again)


@query("f11_watchlist_pin_remove", with_(DEPS + " calendar", f"""SELECT ticker, {t('run_date','run_date')},
    ticker IN ('U7','U8') OR pinned AS pinned FROM entries WHERE ticker NOT IN ('U9')""", **WATCH))
def watchlist_pin_remove(spark, d):
    pinned = ops.watch_pin(watch_entries(spark, d), F.col("ticker").isin("U7", "U8"))
    return ops.watch_remove(pinned, F.col("ticker") == "U9").select("ticker", "run_date", "pinned")


@query("k7_watchlist_update", with_(DEPS + " calendar", f"""SELECT {COLS} FROM entries
    WHERE pinned OR expires_on >= DATE '{TODAY}'""", **WATCH))
def watchlist_update(spark, d):
    """Add a day's missed runners to the stored list, then expire the old."""
    entries = watch_entries(spark, d)
    cut = F.lit("2024-01-18").cast("date")
    merged = ops.watch_upsert(entries.where(F.col("run_date") <= cut),
                              entries.where(F.col("run_date") > cut))
    return ops.watch_pruned(merged, today())


@query("h16_badge", with_(DEPS + " calendar", f"""SELECT ticker, {t('run_date','run_date')}, 'Ran +'||
    {half_even('high_pct',0)}||'% '||CASE DATE '{TODAY}' - run_date WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday'
    ELSE (DATE '{TODAY}' - run_date)||' days ago' END AS badge FROM entries WHERE run_date <= DATE '{TODAY}'""",
    **WATCH))
def badge(spark, d):
    rows = watch_entries(spark, d).where(F.col("run_date") <= today())
    return rows.select("ticker", "run_date", text.badge(
        F.col("high_pct"), F.col("run_date"), today()).alias("badge"))


@query("c14_recent_runner_flag", with_(DEPS + " calendar polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    ticker IN (SELECT ticker FROM entries WHERE pinned OR expires_on >= DATE '{TODAY}') AS is_recent_runner
    FROM polls""", **WATCH))
def recent_runner_flag(spark, d):
    from tapeloom.operators.research import flag_existing
    active = ops.watch_active(watch_entries(spark, d), today())
    return flag_existing(src.polls(spark, d).select("ticker", "poll_ts"), active, ["ticker"],
                         "is_recent_runner")

