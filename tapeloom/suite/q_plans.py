"""Composed jobs and the research starter pack."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tapeloom.config import (
    IntegrityRules,
    PillarThresholds,
    PushRules,
    RetentionRules,
    SESSIONS,
)
from tapeloom.operators import baseline
from tapeloom.operators import evaluations as ev
from tapeloom.operators import news as news_ops
from tapeloom.operators import research as rs
from tapeloom.operators import runners
from tapeloom.plans import actions as actions_plan
from tapeloom.plans import evening, nightly, window_poll
from tapeloom.session import scratch_path, written_once
from tapeloom.sources import adapters as src
from tapeloom.sources import lake, landed
from tapeloom.suite import q_asof as qa
from tapeloom.suite import q_lake as ql
from tapeloom.suite import q_nightly as qn
from tapeloom.suite import q_rules as qr
from tapeloom.suite import q_runners as qu
from tapeloom.suite.registry import SESSION, et, et_instant, mins, pct, query, r, t, with_

CONTEXT = window_poll.PollContext(
    thresholds=PillarThresholds(rvol_min=1.0, price_max=100.0, news_fresh_minutes=1440),
    push_rules=PushRules(max_pushes=4), windows=tuple(SESSIONS.values()))

JUDGED = f"""SELECT *, CASE WHEN p1='pass' AND p2='pass' AND p3='pass' AND p4='pass' AND p5='pass' THEN 'A'
    WHEN p1='pass' AND p2='pass' AND p4='pass' AND p5='pass' THEN 'B' WHEN recent AND p1='pass' THEN 'watch'
    WHEN p1='pass' AND (p2='pass')::INT+(p3='pass')::INT+(p4='pass')::INT+(p5='pass')::INT >= 2 THEN 'watch'
    ELSE 'none' END AS tier FROM (SELECT *, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap>=10 THEN 'pass' ELSE 'fail' END AS p1,
      CASE WHEN rv IS NULL THEN 'unknown' WHEN rv>=1 THEN 'pass' ELSE 'fail' END AS p2,
      CASE WHEN fresh_id IS NOT NULL THEN 'pass' ELSE 'fail' END AS p3,
      CASE WHEN price BETWEEN 2 AND 100 THEN 'pass' ELSE 'fail' END AS p4,
      CASE WHEN conf='low' THEN 'unknown' WHEN float_shares<20000000 THEN 'pass' ELSE 'fail' END AS p5 FROM (
    SELECT b.*, {pct('price','open_price')} AS wc, coalesce({pct('price','prev_close')}, change_pct) AS gap,
      volume/(average_volume_10d*0.05::DOUBLE) AS rv, CASE WHEN float_shares IS NULL OR volume/float_shares > 10
        THEN 'low' ELSE 'medium' END AS conf,
      CASE WHEN {mins('created_at','poll_ts')} <= 1440 THEN news_id END AS fresh_id,
      CASE WHEN {mins('created_at','poll_ts')} <= 1440 THEN {mins('created_at','poll_ts')} END AS age,
      ticker IN (SELECT ticker FROM recents) AS recent FROM (
        SELECT w.*, first_value(price) OVER (PARTITION BY w.ticker, window_start ORDER BY poll_ts) AS open_price,
          y.prev_close, n.news_id, n.created_at FROM (SELECT *, CASE {SESSION('poll_ts')}
            WHEN 'pre' THEN {et_instant('date','04:00')} WHEN 'regular' THEN {et_instant('date','09:30')}
            WHEN 'post' THEN {et_instant('date','16:00')} END AS window_start FROM polls) w
        ASOF LEFT JOIN tagged n ON n.ticker=w.ticker AND n.created_at<=w.poll_ts
        LEFT JOIN udaily y ON y.ticker=w.ticker AND y.date=w.date WHERE window_start IS NOT NULL) b))"""
RECENT = "SELECT DISTINCT ticker FROM udaily WHERE close/prev_close >= 20"
SCORED = f"""SELECT *, coalesce(a*0.5::DOUBLE,0)+coalesce(b*0.3::DOUBLE,0)+coalesce(c*0.2::DOUBLE,0) AS top,
    (a IS NOT NULL)::INT*0.5::DOUBLE+(b IS NOT NULL)::INT*0.3::DOUBLE+(c IS NOT NULL)::INT*0.2::DOUBLE AS mass
    FROM (SELECT *, {qr.rank_sql('wc','poll_ts')} AS a, {qr.rank_sql('rv','poll_ts')} AS b,
      {qr.rank_sql('gap','poll_ts')} AS c FROM judged)"""
ORDER = "poll_ts, -coalesce(score,-1), ticker"
DECIDED = f"""SELECT *, CASE WHEN tier NOT IN ('A','B') THEN 'TIER_NOT_SENT' WHEN before >= p THEN
    'SENT_BEFORE:'||CASE before WHEN 3 THEN 'A' ELSE 'B' END
    WHEN pushed AND before=2 THEN 'UPGRADE:B' WHEN pushed THEN 'FIRST' ELSE 'BUDGET_SPENT:4' END AS push_reason FROM (SELECT *, coalesce(max(CASE WHEN pushed
      THEN p END) OVER (PARTITION BY window_start, ticker ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING),0) AS before FROM (SELECT *, eligible AND sum(eligible::INT) OVER (PARTITION BY window_start
        ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 4 AS pushed FROM (SELECT *, p >
        coalesce(max(p) OVER (PARTITION BY window_start, ticker ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING),0) AS eligible FROM (SELECT *, CASE WHEN mass > 1e-9 THEN round(top/mass, 9) END AS score,
          CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 0 END AS p FROM scored_polls))))"""
K1 = dict(recents=RECENT, judged=JUDGED, scored_polls=SCORED, decided=DECIDED)


def evaluated(spark, d):
    tagged = news_ops.by_symbol(src.news(spark, d))
    # each feeds two branches: days the closes and the runners, polls the rows and their windows' baselines
    daily, polls = written_once(src.user_daily(spark, d), "daily"), written_once(src.polls(spark, d), "polls")
    recent = daily.where(F.col("close") / F.col("prev_close") >= 20)
    return window_poll.evaluate_polls(polls, CONTEXT, tagged, prev_closes=daily, recent_runners=recent)


@query("k1_window_poll", with_("polls tagged udaily", f"""SELECT ticker, {t('date','date')}, {t('poll_ts','poll_ts_utc')},
    {t('window_start','window_start_utc')}, {r('price','price')}, {r('gap','gap_pct')}, {r('wc','window_change_pct')},
    {r('rv','rvol')}, 'fallback' AS rvol_source, float_shares, conf AS float_confidence, {r('round(age,3)','news_age_minutes')},
    fresh_id AS news_id, p1 AS pillar_1_status, p2 AS pillar_2_status, p3 AS pillar_3_status, p4 AS pillar_4_status,
    p5 AS pillar_5_status, ((p1='pass')::INT+(p2='pass')::INT+(p3='pass')::INT+(p4='pass')::INT+(p5='pass')::INT)::BIGINT
    AS pillars_passed, ((p1='unknown')::INT+(p5='unknown')::INT)::BIGINT AS pillars_unknown, tier,
    {r('score','rank_score')}, recent AS is_recent_runner, pushed, push_reason, '{ql.NOW}' AS written_at_utc
    FROM decided""", **K1))
def window_poll_rows(spark, d):
    """The live pipeline over every poll of every window."""
    return window_poll.evaluation_rows(evaluated(spark, d), ql.now()).withColumn(
        "news_age_minutes", F.round("news_age_minutes", 3))


@query("k3_corporate_actions", with_("actions bars calendar", f"""SELECT x.kind, x.n FROM (
    SELECT 'recorded' AS kind, count(*) AS n FROM landed WHERE NOT (k%3=2 AND k%5=0)
    UNION ALL SELECT 'rejected', count(*) FROM landed WHERE k%3=2 AND k%5=0
    UNION ALL SELECT 'affected', count(DISTINCT (ticker, effective_date)) FROM landed WHERE NOT (k%3=2 AND k%5=0)
      AND action_type LIKE '%split'
    UNION ALL SELECT 'baselines_kept', count(*) FROM base
    UNION ALL SELECT 'unreadable', count(DISTINCT action_type) FROM landed WHERE k < 50) x""", landed=ql.LANDED, curve=qa.CURVE, base=qa.BASE))
def corporate_actions(spark, d):
    """Land, append, invalidate; the actions' tickers have no baseline here."""
    root = scratch_path(spark, "lake")
    done = actions_plan.run_actions(
        landed.action_payloads(spark, d), root, qa.base(spark, d),
        F.lit("2000-01-03").cast("date"), ql.now())

    def count(df, kind):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    out = count(lake.read_table(spark, root, "corporate_actions"), "recorded")
    for df, kind in ((done.rejected, "rejected"), (done.affected, "affected"),
                     (done.baselines, "baselines_kept")):
        out = out.unionByName(count(df, kind))
    return out.unionByName(done.payloads.select(F.lit("unreadable").alias("kind"), F.col("unreadable").alias("n")))


UCURVE = qa.CURVE.replace("FROM bars)", "FROM ubars)")
USPLIT = """SELECT DISTINCT ticker, effective_date AS date FROM user_actions WHERE action_type LIKE '%split'
    AND NOT (substr(ticker, 2)::BIGINT%3=2 AND substr(ticker, 2)::BIGINT%5=0)"""


@query("k3_baselines_after_splits", with_("user_actions ubars calendar", f"""SELECT ticker, {t('date','date')},
    minute_offset::BIGINT AS minute_offset, {r('baseline_volume','baseline_volume')}, days_used FROM base b
    WHERE NOT EXISTS (SELECT 1 FROM split_days s WHERE s.ticker=b.ticker AND s.date=b.date)""",
    curve=UCURVE, base=qa.BASE, split_days=USPLIT))
def baselines_after_splits(spark, d):
    """The actions job where splits meet stored baselines: those of the split's ticker and day go."""
    root = scratch_path(spark, "lake")
    stored = baseline.baselines(lambda: src.user_bars(spark, d), src.calendar(spark, d), qa.OFFSETS)
    return actions_plan.run_actions(
        landed.action_payloads(spark, d, src.user_actions(spark, d)), root, stored,
        F.lit("2000-01-03").cast("date"), ql.now()).baselines


def day_rows(spark, root, *tables):
    """Rows of every day of the named tables."""
    out = None
    for name in tables:
        one = lake.row_counts(spark, root, name).select(F.lit(name).alias("table_name"), "date", "rows")
        out = one if out is None else out.unionByName(one)
    return out


EVENING = evening.EveningRules(
    outcomes=qa.RULES, tradability=qa.TRADE, runners=qu.RULES,
    integrity=IntegrityRules(halt_min_silent_minutes=qa.SILENT), bar_minutes=src.BAR_MINUTES)


def _evening_inputs(spark, d):
    """A lake with bars, and closes, verdicts and first headlines as the evenings find them: stored tables."""
    from tapeloom.sources import feeds
    root = scratch_path(spark, "lake")
    lake.append(feeds.bar_rows(src.user_bars(spark, d), ql.now(), src.BAR_MINUTES), root, "bars_1m", "suite")
    bars = lake.read_table(spark, root, "bars_1m").withColumnRenamed("minute_utc", "minute")
    summaries = ev.evaluation_summary(src.day_evals(spark, d), PillarThresholds(), qr.EVAL_ORDER)
    firsts = news_ops.first_news(news_ops.by_symbol(src.news(spark, d)))
    return (root, written_once(src.daily_of(bars), "daily"), written_once(summaries, "summaries"),
            written_once(firsts, "first-news"))


@query("k4_evening_job", with_(qu.DEPS + " bars sessions", f"""SELECT table_name, {t('date','date')}, rows FROM (
    SELECT 'daily_universe' AS table_name, date, 3*count(DISTINCT ticker) AS rows FROM ubars GROUP BY date
    UNION ALL SELECT 'outcomes', date, 6*count(DISTINCT ticker) FROM ubars GROUP BY date
    UNION ALL SELECT 'runners', date, count(*) FROM diagnosed GROUP BY date)""", **qu.PARTS))
def evening_job(spark, d):
    """Bars in the lake become universe, outcomes and runners."""
    root, daily, summaries, firsts = _evening_inputs(spark, d)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(-1, 31)]
    for evening_days in (days[:20], days[20:], days[5:6]):  # two runs, then one day again
        evening.run_evening(spark, root, evening_days, daily, src.actions(spark, d),
                            summaries, firsts, _standard(EVENING), ql.now())
    return day_rows(spark, root, "daily_universe", "outcomes", "runners")


def _standard(rule_set):
    """The lake's outcome columns are fixed at 5, 15, 30 and 60 minutes."""
    from dataclasses import replace
    return replace(rule_set, outcomes=replace(rule_set.outcomes, forward_minutes=(5, 15, 30, 60)))


@query("k4_universe_rows", with_("ubars udaily", f"""SELECT ticker, {t('date','date')}, session, {r('close','close')},
    {r('volume','volume')}, {r('prev_close','prev_close')}, halt_count, suspect_price FROM (SELECT g.*, s.close,
      coalesce(s.volume,0) AS volume, y.prev_close, coalesce(h.n,0) AS halt_count, coalesce(CASE WHEN y.prev_close > 1e-9
      THEN abs(q.close/y.prev_close-1) > 0.8::DOUBLE END, false) AS suspect_price FROM (SELECT ticker, date,
        unnest(['pre','regular','post']) AS session FROM (SELECT DISTINCT ticker, date FROM ubars)) g
      LEFT JOIN rolled s ON s.ticker=g.ticker AND s.date=g.date AND s.session=g.session
      LEFT JOIN rolled q ON q.ticker=g.ticker AND q.date=g.date AND q.session='regular'
      LEFT JOIN udaily y ON y.ticker=g.ticker AND y.date=g.date LEFT JOIN (SELECT ticker, date, count(*) AS n FROM (
        SELECT *, lag(minute) OVER (PARTITION BY ticker, date ORDER BY minute) AS prev FROM ubars)
        WHERE {mins(f"prev + INTERVAL {qa.BAR} MINUTE",'minute')} >= {qa.SILENT} GROUP BY 1,2) h
      ON h.ticker=g.ticker AND h.date=g.date)""", rolled=f"""SELECT ticker, date, {SESSION('minute')} AS session,
      arg_max(close, minute) AS close, sum(volume) AS volume FROM ubars GROUP BY ALL"""))
def universe_rows(spark, d):
    from tapeloom.operators import integrity
    bars = src.user_bars(spark, d)
    halts = integrity.infer_halts(bars, qa.SILENT, qa.BAR)
    return evening.universe_rows(bars, halts, src.user_daily(spark, d), src.actions(spark, d), EVENING,
                                 ql.now()).select(
        "ticker", "date", "session", "close", "volume", "prev_close", "halt_count", "suspect_price")


REGULAR = " AND ".join(f"{SESSION(c)} = 'regular'" for c in ("prev", "minute"))


@query("k4_stored_universe", with_("ubars udaily user_actions", f"""SELECT g.ticker, {t('g.date','date')}, g.session,
    {r('s.close','close')}, {r('coalesce(s.volume,0)','volume')}, {r("y.prev_close/CASE WHEN a.ratio > 1e-9 THEN a.ratio ELSE 1 END",'prev_close')},
    a.ratio IS NOT NULL AS split_flag, {r('a.ratio','split_ratio')}, coalesce(h.n,0) AS halt_count, {r('coalesce(h.mins,0)','halt_minutes')},
    coalesce(CASE WHEN y.prev_close > 1e-9 AND a.action_type IS NULL THEN abs(q.close/y.prev_close-1) > 0.8::DOUBLE END, false)
      AS suspect_price FROM (SELECT ticker, date, unnest(['pre','regular','post']) AS session
      FROM (SELECT DISTINCT ticker, date FROM ubars)) g
    LEFT JOIN rolled s ON s.ticker=g.ticker AND s.date=g.date AND s.session=g.session
    LEFT JOIN rolled q ON q.ticker=g.ticker AND q.date=g.date AND q.session='regular'
    LEFT JOIN udaily y ON y.ticker=g.ticker AND y.date=g.date
    LEFT JOIN on_day a ON a.ticker=g.ticker AND a.effective_date=g.date
    LEFT JOIN (SELECT ticker, date, count(*) AS n, sum(silent) AS mins FROM quiet
      WHERE silent >= {qa.SILENT} AND {REGULAR} GROUP BY 1,2) h
      ON h.ticker=g.ticker AND h.date=g.date""",
    rolled=f"""SELECT ticker, date, {SESSION('minute')} AS session, arg_max(close, minute) AS close,
      sum(volume) AS volume FROM ubars GROUP BY ALL""",
    quiet=f"""SELECT *, {mins(f"prev + INTERVAL {qa.BAR} MINUTE",'minute')} AS silent FROM (SELECT *, lag(minute) OVER
      (PARTITION BY ticker, date ORDER BY minute) AS prev FROM ubars)""",
    on_day="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, effective_date
      ORDER BY action_type, ratio NULLS FIRST) AS n FROM user_actions) WHERE n=1"""))
def stored_universe(spark, d):
    """Rows the evening job left in the lake: silences of the regular session only, closes on the split's basis."""
    root, daily, summaries, firsts = _evening_inputs(spark, d)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(-1, 31)]
    evening.run_evening(spark, root, days, daily, src.user_actions(spark, d),
                        summaries, firsts, _standard(EVENING), ql.now())
    return lake.read_days(spark, root, "daily_universe", days).select(
        "ticker", "date", "session", "close", "volume", "prev_close", "split_flag", "split_ratio",
        "halt_count", "halt_minutes", "suspect_price")


@query("k5_nightly_job", with_(qn.DEPS + " news bars", f"""SELECT table_name, {t('date','date')}, rows FROM (
    SELECT 'snapshots '||klass AS table_name, date, count(*) AS rows FROM keep
      WHERE klass IS NOT NULL AND date >= DATE '2024-01-16' GROUP BY klass, date
    UNION ALL SELECT 'pruned_summary', date, count(*) FROM judged WHERE klass IS NULL
      AND NOT ({qn.UNKNOWN}) AND (ticker, date) IN (SELECT (ticker, date) FROM snaps) GROUP BY date
    UNION ALL SELECT 'bars_1m', date, count(*) FROM (
      SELECT DISTINCT ticker, date, CASE WHEN DATE '2024-01-31' - date > 10 THEN time_bucket(INTERVAL 30 MINUTE, minute)
      ELSE minute END FROM bars) GROUP BY date
    UNION ALL SELECT 'evaluations', date, count(*) FROM day_evals GROUP BY date
    UNION ALL SELECT 'news', {et('created_at')}::DATE, count(*) FROM news GROUP BY 2)""", **qn.CTE, keep=qn.KEEP))
def nightly_job(spark, d):
    """Prune, compact, thin, drop and account on a lake of four tables."""
    root = ql.new_lake(spark, d, "snapshots", "evaluations", "news", "bars_1m")
    rules = RetentionRules(move_threshold_pct=400.0, control_sample_pct=40, bars_raw_days=10,
                           bars_thinned_minutes=30, snapshots_months=0.5)
    polls = lake.read_table(spark, root, "snapshots").withColumnsRenamed(
        {"poll_ts_utc": "poll_ts", "session_volume": "volume"})
    evaluations = lake.read_table(spark, root, "evaluations").withColumnRenamed("poll_ts_utc", "poll_ts")
    bars = written_once(src.user_bars(spark, d), "bars")
    known = written_once(
        qn.classified(spark, d, polls, ev.best_tier(evaluations), bars).where(~(F.col("last_price") > 200)), "classified")
    days = [date(2024, 1, 1) + timedelta(k) for k in range(-1, 31)]
    for night in (days[:18], days[18:]):
        nightly.run_nightly(spark, root, night, known.where(F.col("date").isin(night)), rules,
                            F.lit("2024-01-31").cast("date"), ql.now(), raw_minutes=src.BAR_MINUTES)
    labels = lake.read_table(spark, root, "snapshots").groupBy("date", "retention_class").agg(
        F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("snapshots "), F.col("retention_class")).alias("table_name"), "date", "rows")
    return labels.unionByName(day_rows(spark, root, "pruned_summary", "bars_1m", "evaluations", "news"))


@query("k8_starter_pack", with_(" ".join(dict.fromkeys(f"{qu.DEPS} {qn.DEPS} bars daily".split())), f"""SELECT question, line, n, {r('value','value')} FROM (
    SELECT 'start_hours' AS question, {t("date_trunc('hour', start)",'line')}, count(*) AS n, NULL AS value FROM diagnosed
      WHERE start IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'miss_reasons', v, count(*), NULL FROM (SELECT unnest(string_split(miss_reasons,'|')) AS v
      FROM diagnosed) GROUP BY 2
    UNION ALL SELECT 'low_confidence', date::VARCHAR, NULL, avg((confidence='low')::INT) FROM day_evals GROUP BY 2
    UNION ALL SELECT 'tradability', (coalesce(dollars >= 8000 AND spread <= 60, false))::VARCHAR, count(*),
      avg({pct('p60','price')}) FROM folded f WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.ticker=f.ticker AND g.date=f.date
      AND g.halt_start < until AND ref < g.halt_end) GROUP BY 2
    UNION ALL SELECT 'classes', date::VARCHAR||' '||klass, count(DISTINCT ticker), NULL FROM keep WHERE klass IS NOT NULL
      GROUP BY 2)""", **{**qu.PARTS, **qn.CTE, "keep": qn.KEEP, "refs": qa.REFS, "folded": qa.FOLDED, "gaps": qa.GAPS}))
def starter_pack(spark, d):
    """The saved questions with their answers; verdicts are folded once."""
    c = F.col
    none = F.lit(None).cast("double")
    verdicts = written_once(qu.summaries(spark, d), "summaries")
    runners_table = qu.runner_table(spark, d, verdicts)
    answers = (
        ("start_hours", rs.start_hours(runners_table), c("hour_utc").cast("string"), c("runners"), none),
        ("miss_reasons", runners.reason_counts(runners_table), c("reason"), c("n"), none),
        ("low_confidence", rs.low_confidence_share(src.day_evals(spark, d)), c("date").cast("string"),
         none.cast("long"), c("low_share")),
        ("tradability", rs.outcomes_by_tradability(qa.labels(spark, d), "ret_60m_pct"),
         c("tradeable").cast("string"), c("n"), c("avg_ret")),
        ("classes", rs.tickers_per_class(qn.pruned(spark, d, verdicts).snapshots),
         F.concat_ws(" ", c("date").cast("string"), c("retention_class")), c("tickers"), none),
    )
    out = None
    for question, rows, line, n, value in answers:
        one = rows.select(F.lit(question).alias("question"), line.alias("line"), n.alias("n"), value.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
