"""Retention, data quality, research, journal and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import SESSIONS, PillarThresholds, RetentionRules
from tapeloom.functions import rules
from tapeloom.operators import bars as bar_ops
from tapeloom.operators import calendar as cal
from tapeloom.operators import evaluations as ev
from tapeloom.operators import journal as jn
from tapeloom.operators import listings as ls
from tapeloom.operators import news as news_ops
from tapeloom.operators import quality as ql
from tapeloom.operators import research as rs
from tapeloom.operators import retention as rt
from tapeloom.operators.scan import quantiles
from tapeloom.sources import adapters as src
from tapeloom.suite import q_asof as qa
from tapeloom.suite import q_rules as qr
from tapeloom.suite import q_runners as qu
from tapeloom.suite.registry import et, et_instant, half_even, mins, pct, query, r, sod, t, with_

RULES = RetentionRules(move_threshold_pct=400.0, control_sample_pct=40)
BUSY = 5000.0  # ticker-days above this traded value have bars fetched

# --- retention -------------------------------------------------------------

UMOVE = "coalesce(up>=400,false) OR coalesce(runup>=400,false) OR coalesce(down<=-400,false)"
BUCKET = "(('0x'||substr(sha256(ticker||strftime(date,'%Y-%m-%d')),1,8))::BIGINT % 100)"


def user_moves(spark, d):
    return bar_ops.move_metrics(src.user_bars(spark, d), src.user_daily(spark, d))


@query("b15_mover_predicate", with_("umoves", f"""SELECT {t('date','date')}, count(*) AS n,
    count(*) FILTER (coalesce(up>=100,false) OR coalesce(runup>=100,false) OR coalesce(down<=-100,false)) AS movers
    FROM umoves GROUP BY date"""))
def mover_predicate(spark, d):
    mover = rules.is_mover(F.col("up_move_pct"), F.col("max_runup_pct"), F.col("down_move_pct"), 100.0)
    return user_moves(spark, d).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mover).alias("movers"))


@query("b18_control_sample", with_("evals", f"""SELECT ticker, {t('date','date')}, {BUCKET} AS bucket,
    {BUCKET} < 10 AS sampled FROM (SELECT DISTINCT ticker, date FROM evals)"""))
def control_sample(spark, d):
    days = qa.eval_days(spark, d)
    return days.select(
        "ticker", "date", rules.control_bucket(F.col("ticker"), F.col("date")).alias("bucket"),
        rules.in_control_sample(F.col("ticker"), F.col("date"), 10).alias("sampled"))


TIERS = "SELECT ticker, date, ['none','watch','B','A'][max(k)+1] AS best_tier FROM day_evals GROUP BY 1, 2"
BARSUM = """SELECT m.ticker, m.date, up, down, runup, day_high, day_low, last_price, p.* EXCLUDE (ticker, date)
    FROM (SELECT * FROM umoves WHERE dollars >= 5000) m LEFT JOIN (SELECT ticker, date,
      count(*) AS poll_count, min(poll_ts) AS first_poll, max(poll_ts) AS last_poll, max(volume) AS session_volume,
      max(gap_pct) AS max_gap, max(rvol) AS max_rvol FROM snaps GROUP BY 1,2) p ON p.ticker=m.ticker AND p.date=m.date"""
SNAPSUM = f"""SELECT a.ticker, a.date, {pct('day_high','prev_close')} AS up, {pct('day_low','prev_close')} AS down,
    runup, day_high, day_low, last_price, poll_count, first_poll, last_poll, session_volume, max_gap, max_rvol
    FROM (SELECT ticker, date, max(price) AS day_high, min(price) AS day_low, max(run) AS runup,
      arg_max(price, poll_ts) AS last_price, count(*) AS poll_count, min(poll_ts) AS first_poll,
      max(poll_ts) AS last_poll, max(volume) AS session_volume, max(gap_pct) AS max_gap, max(rvol) AS max_rvol
      FROM (SELECT *, (price/lo-1)*100 AS run FROM (SELECT *, min(price) OVER (PARTITION BY ticker, date
        ORDER BY poll_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo FROM snaps)) GROUP BY 1, 2) a
    LEFT JOIN udaily y ON y.ticker=a.ticker AND y.date=a.date"""
ALLSUM = """SELECT ticker, date, up, down, runup, day_high, day_low, last_price, session_volume, max_gap, max_rvol,
      poll_count, first_poll, last_poll FROM barsum UNION ALL SELECT ticker, date, up, down, runup, day_high, day_low,
      last_price, session_volume, max_gap, max_rvol, poll_count, first_poll, last_poll FROM snapsum s
    WHERE NOT EXISTS (SELECT 1 FROM barsum b WHERE b.ticker=s.ticker AND b.date=s.date)"""
JUDGED = f"""SELECT *, CASE klass WHEN 'mover' THEN 'moved at least 400%' WHEN 'signal' THEN 'reached tier '||best_tier
    WHEN 'control' THEN 'control sample (40%)' ELSE 'not a mover, no signal, not sampled' END AS reason FROM (
      SELECT a.*, coalesce(b.best_tier,'none') AS best_tier, CASE WHEN {UMOVE} THEN 'mover'
        WHEN b.best_tier IN ('watch','B','A') THEN 'signal' WHEN {BUCKET.replace('ticker', 'a.ticker').replace('strftime(date', 'strftime(a.date')} < 40 THEN 'control' END
        AS klass FROM allsum a LEFT JOIN tiers b ON b.ticker=a.ticker AND b.date=a.date)"""
CTE = dict(tiers=TIERS, barsum=BARSUM, snapsum=SNAPSUM, allsum=ALLSUM, judged=JUDGED)
DEPS = "umoves udaily snaps day_evals"


def bar_summaries(spark, d):
    return summaries_of(src.user_bars(spark, d), src.user_daily(spark, d), src.snapshots(spark, d))


def summaries_of(bars, daily, polls):
    busy = bar_ops.move_metrics(bars, daily).where(F.col("dollar_volume") >= BUSY)
    return rt.summaries_from_bars(busy, polls)


def all_summaries(spark, d, polls=None, bars=None):
    polls = src.snapshots(spark, d) if polls is None else polls
    bars = src.user_bars(spark, d) if bars is None else bars
    daily = src.daily_of(bars)
    return rt.combine_summaries(
        summaries_of(bars, daily, polls), rt.summaries_from_snapshots(polls, daily))


def classified(spark, d, polls=None, best=None, bars=None):
    """From stored polls, best tiers and bars where they are given."""
    best = ev.best_tier(src.day_evals(spark, d)) if best is None else best
    return rt.classify(all_summaries(spark, d, polls, bars), best, RULES)


SUM_COLS = f"""ticker, {t('date','date')}, {r('up','up_move_pct')}, {r('down','down_move_pct')},
    {r('runup','max_runup_pct')}, {r('day_high','day_high')}, {r('day_low','day_low')},
    {r('last_price','last_price')}, {r('session_volume','session_volume')}, {r('max_gap','max_gap_pct')},
    {r('max_rvol','max_rvol')}, poll_count, {t('first_poll','first_poll_ts')}, {t('last_poll','last_poll_ts')}"""


@query("d14_snapshot_summaries", with_(DEPS, f"SELECT {SUM_COLS} FROM snapsum", **CTE))
def snapshot_summaries(spark, d):
    return rt.summaries_from_snapshots(src.snapshots(spark, d), src.user_daily(spark, d))


@query("d15_bar_summaries", with_(DEPS, f"""SELECT {SUM_COLS.replace('poll_count,', 'coalesce(poll_count,0) AS poll_count,')}
    FROM barsum""", **CTE))
def bar_path_summaries(spark, d):
    return bar_summaries(spark, d)


@query("c16_bars_win_over_snapshots", with_(DEPS, f"SELECT {SUM_COLS} FROM allsum", **CTE))
def bars_win(spark, d):
    return all_summaries(spark, d)


@query("b17_retention_class", with_(DEPS, f"""SELECT ticker, {t('date','date')}, best_tier,
    klass AS retention_class, reason FROM judged""", **CTE))
def retention_class(spark, d):
    return classified(spark, d).select("ticker", "date", "best_tier", "retention_class", "reason")


UNKNOWN = "last_price > 200"  # metrics job failed for these ticker-days
KEEP = f"""SELECT s.*, CASE WHEN j.ticker IS NULL THEN 'signal' ELSE j.klass END AS klass FROM snaps s
    LEFT JOIN (SELECT * FROM judged WHERE NOT ({UNKNOWN})) j ON j.ticker=s.ticker AND j.date=s.date"""


def pruned(spark, d, best=None):
    known = classified(spark, d, best=best).where(~(F.col("last_price") > 200))
    return rt.prune(src.snapshots(spark, d), known, RULES)


@query("c17_pruned_snapshots", with_(DEPS, f"""SELECT ticker, {t('poll_ts','poll_ts')}, {r('price','price')},
    klass AS retention_class FROM keep WHERE klass IS NOT NULL""", **CTE, keep=KEEP))
def pruned_snapshots(spark, d):
    return pruned(spark, d).snapshots.select("ticker", "poll_ts", "price", "retention_class")


REPORT = f"""SELECT {t('date','date')}, sum(n)::BIGINT AS rows_before,
    coalesce(sum(n) FILTER (klass IS NOT NULL),0)::BIGINT AS rows_after,
    count(*) FILTER (klass='mover') AS mover_count, count(*) FILTER (klass='signal') AS signal_count,
    count(*) FILTER (klass='control') AS control_count, count(*) FILTER (klass IS NULL) AS dropped_count,
    400.0::DOUBLE AS move_threshold_pct FROM (SELECT ticker, date, klass, count(*) AS n FROM keep GROUP BY ALL)
    GROUP BY date"""


@query("d16_prune_report", with_(DEPS, REPORT, **CTE, keep=KEEP))
def prune_report(spark, d):
    return pruned(spark, d).report


@query("d17_pruned_summary", with_(DEPS, f"""SELECT ticker, {t('date','date')}, poll_count,
    {t('first_poll','first_poll_ts_utc')}, {t('last_poll','last_poll_ts_utc')}, {r('day_high','session_high')},
    {r('day_low','session_low')}, {r('last_price','last_price')}, {r('session_volume','session_volume')},
    {r('max_gap','max_gap_pct')}, {r('max_rvol','max_rvol')}, {r('up','up_move_pct')}, {r('down','down_move_pct')},
    best_tier, reason AS drop_reason FROM judged WHERE klass IS NULL AND NOT ({UNKNOWN})
    AND (ticker, date) IN (SELECT (ticker, date) FROM snaps)""", **CTE))
def pruned_summary(spark, d):
    return pruned(spark, d).summary


@query("b32_retention_ages", with_("bars", f"""SELECT {t('date','date')}, bool_and(DATE '2024-01-31' - date > 20) AS thin,
    bool_and(date < DATE '2024-01-31' - 15) AS drop_snapshots FROM bars GROUP BY date"""))
def retention_ages(spark, d):
    """As of 31 January: bars older than 20 days, snapshots than half a month."""
    rule_set = RetentionRules(bars_raw_days=20, snapshots_months=0.5)
    today = F.lit("2024-01-31").cast("date")
    days = src.bars(spark, d).select("date").distinct()
    return days.select(
        "date", rt.due_for_thinning(F.col("date"), today, F.lit(1), rule_set).alias("thin"),
        (F.col("date") < rt.snapshot_cutoff(today, rule_set)).alias("drop_snapshots"))


# --- data quality ----------------------------------------------------------

LATENCY = f"""SELECT *, {et('created_at')}::DATE AS date,
    (epoch_us(received_at)-epoch_us(created_at))/1000000.0::DOUBLE AS lat FROM news"""
P95 = "arg_min(lat, rn) FILTER (rn >= greatest(1, ceil(0.95::DOUBLE*n)))"
MARKS = f"""SELECT date, {P95} AS p95, median(lat) AS med, count(*) AS n FROM (SELECT *, row_number() OVER
    (PARTITION BY date ORDER BY lat) AS rn, count(*) OVER (PARTITION BY date) AS n FROM lat) GROUP BY date"""


@query("d21_nearest_rank_percentile", with_("news", f"""SELECT {t('date','date')}, {r('p95','p95')} FROM marks""",
       lat=LATENCY, marks=MARKS))
def nearest_rank(spark, d):
    return quantiles(news_ops.news_rows(src.news(spark, d)), ["date"], "feed_latency_s", {"p95": 0.95})


@query("d22_interpolated_median", with_("news", f"""SELECT {t('date','date')}, {r('med','median')} FROM marks""",
       lat=LATENCY, marks=MARKS))
def interpolated_median(spark, d):
    return quantiles(news_ops.news_rows(src.news(spark, d)), ["date"], "feed_latency_s",
                     interpolated={"median": 0.5})


@query("d23_share", with_("evals", f"""SELECT {t('date','date')}, {r('''count(*) FILTER (confidence='low' AND
    l_quantity>40)/nullif(count(*) FILTER (l_quantity>40),0)::DOUBLE''','share')} FROM evals GROUP BY date"""))
def share(spark, d):
    """No evaluation at all gives NULL, not zero."""
    big = F.col("l_quantity") > 40
    return src.evals(spark, d).groupBy("date").agg(ql.share(
        F.count_if(big & (F.col("confidence") == "low")), F.count_if(big)).alias("share"))


QCOLS = ("missing_field_count", "api_errors", "suspect_price_rows", "corporate_actions_applied",
         "rvol_baselines_recomputed", "halt_count", "inferred_halt_count", "mover_count",
         "control_count", "dropped_count")


def _qsql(name, rel, where="", **values):
    cells = [f"{values.get(c, '0')}::BIGINT AS {c}" for c in QCOLS]
    cells.append(r(values.get("ws_disconnect_minutes", "0"), "ws_disconnect_minutes"))
    for c in ("pillar5_low_confidence_share", "news_latency_median_s", "news_latency_p95_s",
              "tradeable_share", "move_threshold_pct"):
        cells.append(r(values.get(c, "NULL"), c))
    polls = ", ".join(f"({values.get(c, 'NULL')})::BIGINT AS {c}" for c in ("polls_expected", "polls_completed"))
    return (f"SELECT {t('date', 'date')}, '{name}' AS table_name, {values['rows']}::BIGINT AS rows_collected, "
            f"{', '.join(cells)}, {polls}, "
            f"NULL::VARCHAR AS note FROM {rel}")


CADENCE, LATE = 30, 10  # minutes
SLOTS = f"""SELECT date, slot FROM (SELECT date, {et_instant('date','04:00')} + to_minutes(i*{CADENCE}) AS slot
    FROM calendar, range(32) r(i)) WHERE NOT (dayofweek(date)=5 AND slot >= {et_instant('date','13:00')})"""
ANSWERED = f"""SELECT slot, min(ts) AS first_poll FROM (SELECT ts, {et_instant('date','04:00')}
      + to_minutes((floor({mins(et_instant('date','04:00'),'ts')}/{CADENCE})*{CADENCE})::BIGINT) AS slot
    FROM ticks WHERE ticker='click' AND {sod('ts')} >= 14400 AND {sod('ts')} < 72000) GROUP BY slot"""
COVERAGE = f"""SELECT date, count(*) AS polls_expected, count(first_poll) AS polls_completed,
    count(*) FILTER (first_poll IS NULL) AS polls_missed,
    count(*) FILTER ({mins('slot','first_poll')} > {LATE}) AS polls_late, max(run)*{CADENCE} AS gap FROM (
      SELECT *, n - coalesce(max(CASE WHEN first_poll IS NOT NULL THEN n END) OVER (PARTITION BY date ORDER BY n), 0) AS run
      FROM (SELECT s.*, a.first_poll, row_number() OVER (PARTITION BY date ORDER BY s.slot) AS n
        FROM slots s LEFT JOIN answered a ON a.slot=s.slot)) GROUP BY date"""
COVER = dict(slots=SLOTS, answered=ANSWERED, covered=COVERAGE)


def coverage(spark, d):
    """Clicks stand for answered polls, due every half hour of the session; Fridays close early."""
    windows = tuple(SESSIONS.values())
    hours = cal.with_hours(src.calendar(spark, d), early_close=F.dayofweek("date") == 6)
    clicks = src.ticks(spark, d).where(F.col("ticker") == "click")
    return ql.poll_coverage(
        cal.expected_polls(hours, windows, CADENCE), clicks, windows, CADENCE, LATE, at="ts")


@query("d20_poll_coverage", with_("calendar ticks", f"""SELECT {t('date','date')}, polls_expected, polls_completed,
    polls_missed, polls_late, {r('gap','longest_gap_minutes')} FROM covered""", **COVER))
def poll_coverage(spark, d):
    """Polls expected, completed, missed and late, and the longest gap of every trading day."""
    return coverage(spark, d)


OUTAGE_DAY = """SELECT day AS date, sum(epoch_us(coalesce(ended, day + INTERVAL 1 DAY)) - epoch_us(started))
    /60000000.0::DOUBLE AS minutes FROM outages GROUP BY day"""
LABELLED = f"""SELECT f.ticker, f.date, coalesce(dollars >= 8000 AND spread <= 60, false) AS tradeable FROM folded f"""
QUALITY = " UNION ALL ".join([
    _qsql("evaluations", "(SELECT e.*, splits FROM (SELECT date, count(*) AS n, count(*) FILTER (confidence='low') AS low"
          " FROM day_evals GROUP BY 1) e LEFT JOIN applied a ON a.date=e.date)",
          rows="n", pillar5_low_confidence_share="low/n::DOUBLE", rvol_baselines_recomputed="coalesce(splits,0)"),
    _qsql("outcomes", """(SELECT l.date, count(*) AS n, count(*) FILTER (tradeable) AS ok, any_value(h.halts) AS halts,
          any_value(a.actions) AS actions FROM labels_of_day l LEFT JOIN (SELECT date, count(*) AS halts FROM gaps GROUP BY 1) h
          ON h.date=l.date LEFT JOIN applied a ON a.date=l.date GROUP BY 1)""", corporate_actions_applied="coalesce(actions,0)",
          rows="n", tradeable_share="ok/n::DOUBLE", halt_count="coalesce(halts,0)",
          inferred_halt_count="coalesce(halts,0)"),
    _qsql("news", "(SELECT m.*, coalesce(o.minutes,0) AS minutes FROM marks m LEFT JOIN outage_day o ON o.date=m.date)",
          rows="n", news_latency_p95_s="p95", news_latency_median_s="med", ws_disconnect_minutes="minutes"),
    _qsql("snapshots", """(SELECT p.* REPLACE (p.date::DATE AS date), c.polls_expected, c.polls_completed, f.nulls, f.suspects,
          x.errors FROM report p LEFT JOIN covered c ON c.date=p.date::DATE LEFT JOIN faults f ON f.date=p.date::DATE
          LEFT JOIN failures x ON x.date=p.date::DATE)""", rows="rows_after", polls_expected="polls_expected",
          polls_completed="polls_completed", missing_field_count="coalesce(nulls,0)",
          suspect_price_rows="coalesce(suspects,0)", api_errors="coalesce(errors,0)",
          mover_count="mover_count", control_count="control_count", dropped_count="dropped_count",
          move_threshold_pct="move_threshold_pct"),
])
APPLIED = """SELECT effective_date AS date, count(*) AS actions,
    count(DISTINCT ticker) FILTER (action_type LIKE '%split') AS splits FROM user_actions GROUP BY 1"""
FAULTS = """SELECT coalesce(a.date, b.date) AS date, nulls, suspects FROM (SELECT date, count(*) FILTER (float_shares IS NULL)
      + count(*) FILTER (average_volume_10d IS NULL) AS nulls FROM snaps GROUP BY date) a
    FULL JOIN (SELECT date, count(*) FILTER (suspect) AS suspects FROM known GROUP BY date) b ON b.date=a.date"""
FAILURES = "SELECT date, count(*) AS errors FROM ticks WHERE ticker='error' GROUP BY date"
QCTE = dict(CTE, keep=KEEP, report=REPORT, lat=LATENCY, marks=MARKS, outages=qa.OUTAGES, outage_day=OUTAGE_DAY,
            refs=qa.REFS, folded=qa.FOLDED, gaps=qa.GAPS, labels_of_day=LABELLED, labelled=qr.LABELLED, k2=qr.K2,
            known=qr.K2_KNOWN, **COVER, applied=APPLIED, faults=FAULTS, failures=FAILURES, quality=QUALITY)
QDEPS = DEPS + " news health bars daily calendar ubars polls ticks user_actions"


def quality_rows(spark, d):
    from tapeloom.operators import integrity
    halts = integrity.halt_summary(integrity.infer_halts(src.bars(spark, d), qa.SILENT, qa.BAR))
    health = src.health(spark, d).withColumnRenamed("day", "date")
    midnight = F.date_add(F.col("date"), 1).cast("timestamp")
    down = news_ops.outage_minutes(
        news_ops.outages(health, ["date"]).withColumn("_end", midnight), ["date"], F.col("_end"))
    applied = ql.action_counts(src.user_actions(spark, d))
    suspects = qr.collected_with_facts(spark, d).snapshots.groupBy("date").agg(
        F.count_if("suspect_price").alias("suspect_price_rows"))
    return ql.union_rows(
        ql.evaluation_quality(src.day_evals(spark, d), applied),
        ql.outcome_quality(qa.labels(spark, d), halts, applied),
        ql.news_quality(news_ops.news_rows(src.news(spark, d)), down),
        ql.snapshot_quality(
            pruned(spark, d).report, suspects, coverage(spark, d),
            ql.missing_fields(src.snapshots(spark, d), ("float_shares", "average_volume_10d")),
            ql.failed_requests(src.ticks(spark, d), F.col("ticker") == "error")),
    )


@query("d20_quality_rows", with_(QDEPS, "SELECT * FROM quality", **QCTE))
def quality(spark, d):
    return quality_rows(spark, d)


WARN = f"""SELECT date, table_name, code, {r('value','value')} FROM (
    SELECT date, table_name, 'news_feed_latency' AS code, news_latency_p95_s AS value FROM quality WHERE news_latency_p95_s > 60
    UNION ALL SELECT date, table_name, 'float_confidence', pillar5_low_confidence_share FROM quality
      WHERE pillar5_low_confidence_share > 0.5
    UNION ALL SELECT date, table_name, 'news_feed_gap', ws_disconnect_minutes FROM quality WHERE ws_disconnect_minutes > 0
    UNION ALL SELECT date, table_name, 'api_errors', api_errors FROM quality WHERE api_errors > 0
    UNION ALL SELECT date, table_name, 'suspect_price', suspect_price_rows FROM quality WHERE suspect_price_rows > 0)"""


@query("b28_quality_warnings", with_(QDEPS, WARN, **QCTE))
def quality_warnings(spark, d):
    return ql.warnings(quality_rows(spark, d))


@query("h19_notes", with_("day_evals", f"""SELECT {t('cutoff','cutoff')}, held AS held_back_days, 10.0::DOUBLE AS control_weight
    FROM (SELECT date AS cutoff, n-i AS held FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM day_evals)) WHERE i = floor(n*0.7::DOUBLE))"""))
def notes(spark, d):
    """What a reader of rates must know: the held-back days and the control rows' weight."""
    return rs.reading_notes(src.day_evals(spark, d), control_pct=10)


# --- research --------------------------------------------------------------

@query("b29_holdout_filter", with_("evals", f"""SELECT {t('date','date')}, count(*) AS n FROM evals WHERE date < (
    SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM evals)) WHERE i = floor(n*0.7::DOUBLE)) GROUP BY date"""))
def holdout_filter(spark, d):
    rows = src.evals(spark, d)
    return rs.before_holdout(rows, rows).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


RAN = "SELECT DISTINCT ticker, date FROM evals WHERE was_runner"


def eval_runners(spark, d):
    return src.evals(spark, d).where("was_runner").select("ticker", "date").distinct()


COLLECTED = dict(labelled=qr.LABELLED, k2=qr.K2, refs="""SELECT ticker, date, max(float_shares) AS float_shares
    FROM k2 GROUP BY 1, 2""")
JOINED = f"""SELECT s.date, s.ticker, min(klass) AS retention_class, max(rvol) AS max_rvol, max(gap_pct) AS max_gap,
    any_value(f.float_shares) AS float_shares FROM keep s LEFT JOIN refs f ON f.ticker=s.ticker AND f.date=s.date
    WHERE klass IS NOT NULL GROUP BY 1, 2"""


def snapshot_facts(spark, d):
    kept = pruned(spark, d).snapshots.withColumn("suspect_price", F.lit(None).cast("boolean"))
    return rs.snapshots_with_reference(kept, qr._collected(spark, d).reference)


@query("c19_snapshots_with_reference", with_(DEPS + " polls", f"""SELECT ticker, {t('date','date')}, retention_class,
    {r('max_rvol','max_rvol')}, {r('max_gap','max_gap_pct')}, float_shares FROM joined""",
    **CTE, keep=KEEP, **COLLECTED, joined=JOINED))
def snapshots_with_reference(spark, d):
    return snapshot_facts(spark, d)


@query("c19_snapshots_asof_reference", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {t('seen','asof_ts_utc')} FROM (SELECT p.ticker, p.poll_ts, (SELECT max(k.poll_ts) FROM (SELECT * FROM (
      SELECT *, lag(confidence) OVER w AS pc, row_number() OVER w AS rn FROM (SELECT *, CASE WHEN float_shares IS NULL
        OR volume/float_shares > 10 THEN 'low' ELSE 'medium' END AS confidence FROM k2)
      WINDOW w AS (PARTITION BY ticker, date ORDER BY poll_ts)) WHERE rn=1 OR pc IS DISTINCT FROM confidence) k
      WHERE k.ticker=p.ticker AND k.poll_ts <= p.poll_ts) AS seen FROM polls p)""",
    labelled=qr.LABELLED, k2=qr.K2))
def snapshots_asof_reference(spark, d):
    """The point-in-time variant: no look-ahead inside the day."""
    from tapeloom.operators.scan import asof_join
    polls = src.polls(spark, d).select("ticker", "poll_ts")
    found = asof_join(polls, qr._collected(spark, d).reference, ["ticker"], "poll_ts", "asof_ts_utc",
                      ["asof_ts_utc"])
    return found.select("ticker", "poll_ts", "matched.asof_ts_utc")


@query("c20_exists_flag", with_("evals", f"""SELECT ticker, {t('date','date')}, EXISTS (SELECT 1 FROM ran x
    WHERE x.ticker=y.ticker AND x.date=y.date) AS ran FROM (SELECT DISTINCT ticker, date FROM evals) y""", ran=RAN))
def exists_flag(spark, d):
    return rs.flag_existing(qa.eval_days(spark, d), eval_runners(spark, d), ["ticker", "date"], "ran")


@query("c21_evaluations_with_outcomes", with_("day_evals ubars", f"""SELECT e.ticker, {t('e.date','date')}, tier,
    {r('day_high','day_high')} FROM day_evals e JOIN (SELECT ticker, date, max(high) AS day_high FROM ubars
    GROUP BY 1,2) o ON o.ticker=e.ticker AND o.date=e.date"""))
def evaluations_with_outcomes(spark, d):
    days = src.user_bars(spark, d).groupBy("ticker", "date").agg(F.max("high").alias("day_high"))
    return src.day_evals(spark, d).join(days, ["ticker", "date"]).select(
        "ticker", "date", "tier", "day_high")


@query("d24_weighted_hit_rate", with_(qu.DEPS + " umoves snaps", f"""SELECT count(*) AS rows_kept,
    {r('sum(w)','estimated_population')}, {r('sum(CASE WHEN ran THEN w ELSE 0 END)','estimated_runners')},
    {r('sum(CASE WHEN ran THEN w ELSE 0 END)/nullif(sum(w),0)','hit_rate')} FROM (SELECT *,
      CASE klass WHEN 'control' THEN 2.5::DOUBLE ELSE 1 END AS w, EXISTS (SELECT 1 FROM detected x WHERE is_runner
        AND x.ticker=k.ticker AND x.date=k.date) AS ran FROM (SELECT date, ticker, min(klass) AS klass,
        max(rvol) AS max_rvol FROM keep WHERE klass IS NOT NULL GROUP BY 1,2) k WHERE max_rvol >= 1)""",
    rolled=qu.ROLLED_U, detected=qu.DETECTED, **CTE, keep=KEEP))
def weighted_hit_rate(spark, d):
    """Control rows weigh 100/40."""
    days = pruned(spark, d).snapshots.groupBy("date", "ticker").agg(
        F.min("retention_class").alias("retention_class"), F.max("rvol").alias("max_rvol")
    ).where(F.col("max_rvol") >= 1)
    ran = qu.detected(spark, d).where("is_runner")
    return rs.weighted_hit_rate(rs.flag_existing(days, ran, ["ticker", "date"], "ran"), 40)


RUN = dict(qu.PARTS)


@query("d29_move_start_histogram", with_(qu.DEPS, f"""SELECT strftime({et('start')}, '%H:%M') AS move_start_et,
    count(*) AS runners FROM diagnosed WHERE start IS NOT NULL GROUP BY 1""", **RUN))
def move_start_histogram(spark, d):
    return rs.move_start_histogram(qu.runner_table(spark, d))


@query("d29_move_start_by_hour", with_(qu.DEPS, f"""SELECT {t("date_trunc('hour', start)",'hour_utc')},
    count(*) AS runners FROM diagnosed WHERE start IS NOT NULL GROUP BY date_trunc('hour', start)""", **RUN))
def move_start_by_hour(spark, d):
    return rs.move_start_histogram(qu.runner_table(spark, d), "hour")


@query("d30_pillar_base_rates", with_("statuses", """SELECT pillar, round(hit_rate,6)+0.0::DOUBLE AS hit_rate, n FROM (
    SELECT 'gap >= 10%' AS pillar, avg(ran::INT) AS hit_rate, count(*) AS n FROM per WHERE gap_pct >= 10
    UNION ALL SELECT 'rvol >= 5', avg(ran::INT), count(*) FROM per WHERE rvol >= 5
    UNION ALL SELECT 'float < 20M', avg(ran::INT), count(*) FROM per WHERE float_shares < 20000000
    UNION ALL SELECT 'fresh news', avg(ran::INT), count(*) FROM per WHERE had_news)""",
    per="""SELECT ticker, date, max(gap_pct) AS gap_pct, max(rvol) AS rvol, max(float_shares) AS float_shares,
    bool_or(p3='pass') AS had_news, bool_or(was_runner) AS ran FROM statuses GROUP BY 1,2"""))
def pillar_base_rates(spark, d):
    return rs.pillar_base_rates(src.scored(spark, d), eval_runners(spark, d), PillarThresholds())


@query("d31_low_confidence_share", with_("evals", f"""SELECT {t('date','date')},
    {r("avg((confidence='low')::INT)",'low_share')} FROM evals GROUP BY date"""))
def low_confidence_share(spark, d):
    return rs.low_confidence_share(src.evals(spark, d))


@query("d32_outcomes_by_tradability", with_("bars daily", f"""SELECT tradeable, count(*) AS n,
    {r('avg(ret_60m_pct)','avg_ret')}, {r('avg(mfe_pct)','avg_mfe')}, {r('avg(mae_pct)','avg_mae')}
    FROM (SELECT coalesce(dollars >= 8000 AND spread <= 60, false) AS tradeable, {pct('p60','price')} AS ret_60m_pct,
      {pct('hi','price')} AS mfe_pct, {pct('lo','price')} AS mae_pct, EXISTS (SELECT 1 FROM gaps g
      WHERE g.ticker=f.ticker AND g.date=f.date AND g.halt_start < until AND ref < g.halt_end) AS halted
      FROM folded f) WHERE NOT halted GROUP BY 1""", refs=qa.REFS, folded=qa.FOLDED, gaps=qa.GAPS))
def outcomes_by_tradability(spark, d):
    return rs.outcomes_by_tradability(qa.labels(spark, d), "ret_60m_pct")


@query("d33_tickers_per_class", with_(DEPS, f"""SELECT {t('date','date')}, klass AS retention_class,
    count(DISTINCT ticker) AS tickers FROM keep WHERE klass IS NOT NULL GROUP BY date, klass""", **CTE, keep=KEEP))
def tickers_per_class(spark, d):
    return rs.tickers_per_class(pruned(spark, d).snapshots)


HISTORY = """SELECT 'bars' AS table_name, count(DISTINCT date) AS days, count(*) AS rows FROM bars
    UNION ALL SELECT 'evaluations', count(DISTINCT date), count(*) FROM evals
    UNION ALL SELECT 'news', count(DISTINCT date), count(*) FROM (SELECT {et} AS date FROM news)
    UNION ALL SELECT 'snapshots', count(DISTINCT date), count(*) FROM polls""".replace(
    "{et}", f"{et('created_at')}::DATE")


def history(spark, d):
    return rs.table_history({
        "bars": src.bars(spark, d), "evaluations": src.evals(spark, d),
        "news": news_ops.news_rows(src.news(spark, d)), "snapshots": src.polls(spark, d)})


@query("d34_table_history", with_("bars evals news polls", HISTORY))
def table_history(spark, d):
    return history(spark, d)


@query("g2_union_all", with_("bars evals news polls", f"SELECT sum(rows)::BIGINT AS rows, max(days) AS days FROM ({HISTORY})"))
def union_all(spark, d):
    return history(spark, d).agg(F.sum("rows").alias("rows"), F.max("days").alias("days"))


# --- journal ---------------------------------------------------------------

@query("a19_journal_export", with_("journal", f"""SELECT ticker, {t('date','date')}, NULL::VARCHAR AS alert_id, action,
    {r('entry','entry')}, {r('exit','exit')}, {r('size','size')}, NULL::VARCHAR AS note, tag1||'|'||tag2 AS tags,
    {t('created_at','created_at_utc')}, {t('created_at','written_at_utc')} FROM journal"""))
def journal_export(spark, d):
    return jn.export_rows(src.journal(spark, d))


@query("d39_realised_pnl", with_("journal", f"""SELECT {t('date','date')}, count(pnl) AS closed,
    {r('sum(pnl)','pnl')} FROM (SELECT *, CASE WHEN action='traded' THEN (exit-entry)*size END AS pnl FROM journal)
    GROUP BY date"""))
def realised_pnl(spark, d):
    return jn.pnl(src.journal(spark, d)).groupBy("date").agg(
        F.count("pnl").alias("closed"), F.sum("pnl").alias("pnl"))


@query("e15_latest_action", with_("journal", f"""SELECT ticker, {t('date','date')},
    arg_max(action, (created_at, entry_id)) AS action FROM journal GROUP BY ticker, date"""))
def latest_action(spark, d):
    return jn.latest_actions(src.journal(spark, d))


@query("f6_recent_entries", with_("journal", """SELECT ticker, entry_id, place FROM (SELECT *, row_number() OVER
    (PARTITION BY ticker ORDER BY created_at DESC, entry_id DESC) AS place FROM journal) WHERE place <= 3"""))
def recent_entries(spark, d):
    return jn.recent_per_ticker(src.journal(spark, d), 3).select("ticker", "entry_id", "place")


@query("h18_tags_round_trip", with_("journal", """SELECT entry_id, '["'||tag1||'","'||tag2||'"]' AS encoded,
    2::BIGINT AS n_tags FROM journal"""))
def tags_round_trip(spark, d):
    tags = jn.decode_tags(F.col("tags_json"))
    return src.journal(spark, d).select(
        "entry_id", jn.encode_tags(tags).alias("encoded"), F.size(tags).alias("n_tags"))


@query("c22_skipped_that_ran", with_("journal evals", f"""SELECT entry_id, j.ticker, {t('j.date','date')},
    {r('high_of_day_pct','high_of_day_pct')} FROM journal j JOIN (SELECT 'C'||(l_partkey%1500) AS ticker, date,
      max(gap_pct) AS high_of_day_pct FROM evals WHERE was_runner GROUP BY 1, 2) x ON x.ticker=j.ticker AND x.date=j.date
    WHERE action='skipped'"""))
def skipped_that_ran(spark, d):
    ran = src.evals(spark, d).where("was_runner").groupBy(
        F.concat(F.lit("C"), (F.col("l_partkey") % 1500).cast("string")).alias("ticker"), "date").agg(
        F.max("gap_pct").alias("high_of_day_pct"))
    return rs.skipped_that_ran(src.journal(spark, d), ran).select(
        "entry_id", "ticker", "date", "high_of_day_pct")


# --- listings --------------------------------------------------------------

CUT = "2001-10-20"
KNOWN = f"""SELECT 'P'||l_partkey AS ticker, min(l_shipdate)::DATE AS first_seen, max(l_shipdate)::DATE AS last_seen
    FROM lineitem WHERE l_shipdate < DATE '{CUT}' GROUP BY 1"""
SEEN = f"SELECT DISTINCT 'P'||l_partkey AS ticker FROM lineitem WHERE l_shipdate >= DATE '{CUT}'"
AFTER = f"""SELECT coalesce(k.ticker,s.ticker) AS ticker, coalesce(first_seen, DATE '{CUT}') AS first_seen,
    CASE WHEN s.ticker IS NOT NULL THEN DATE '{CUT}' ELSE last_seen END AS last_seen, CASE WHEN s.ticker IS NOT NULL
    THEN 'active' WHEN DATE '{CUT}' - last_seen >= 60 THEN 'delisted' ELSE 'active' END AS status
    FROM known k FULL JOIN seen s ON s.ticker=k.ticker"""


def seen(spark, d):
    li = src.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit(CUT).cast("date"))
    return li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"))


def after(spark, d):
    return ls.transitions(src.known_listings(spark, d, CUT), seen(spark, d),
                          F.lit(CUT).cast("date"), 60)


@query("c23_listing_transitions", f"""WITH known AS ({KNOWN}), seen AS ({SEEN}), after AS ({AFTER})
    SELECT ticker, {t('first_seen','first_seen')}, {t('last_seen','last_seen')}, status,
    NULL::VARCHAR AS ticker_canonical_id FROM after""")
def listing_transitions(spark, d):
    return after(spark, d)


TRADED = """SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE isodow(l_shipdate) < 6
    AND NOT (month(l_shipdate)=9 AND day(l_shipdate)<=7)"""


@query("c23_absent_sessions", f"""WITH known AS ({KNOWN}), seen AS ({SEEN}), traded AS ({TRADED}),
    both_ AS (SELECT coalesce(k.ticker, s.ticker) AS ticker, s.ticker IS NOT NULL AS here, last_seen,
      (SELECT count(*) FROM traded d WHERE d.date > k.last_seen AND d.date <= DATE '{CUT}') AS absent
      FROM known k FULL JOIN seen s ON s.ticker=k.ticker)
    SELECT ticker, {t(f"CASE WHEN here THEN DATE '{CUT}' ELSE last_seen END",'last_seen')},
    CASE WHEN NOT here AND absent >= 40 THEN 'delisted' ELSE 'active' END AS status FROM both_""")
def absent_sessions(spark, d):
    """Listings gone for 40 trading days: weekdays with shipments, outside the holiday week."""
    day = F.to_date("l_shipdate")
    traded = src.table(spark, d, "lineitem").select(day.alias("date")).distinct().where(
        (F.weekday("date") < 5) & ~((F.month("date") == 9) & (F.dayofmonth("date") <= 7)))
    rows = ls.transitions(src.known_listings(spark, d, CUT), seen(spark, d), F.lit(CUT).cast("date"), 40, traded)
    return rows.select("ticker", "last_seen", "status")


RENAME = f"""WITH RECURSIVE known AS ({KNOWN}), seen AS ({SEEN}), after AS ({AFTER}), edge AS (SELECT p_partkey AS k,
      'P'||p_partkey AS old, 'P'||(p_partkey+1) AS new, DATE '1998-01-01' + (p_partkey%700)::INT AS day
      FROM part WHERE p_size=3),
    chain AS (SELECT k, old, new, day, old AS root, day AS since FROM edge UNION ALL
      SELECT c.k, c.old, c.new, c.day, e.old, e.day FROM chain c JOIN edge e ON e.new=c.root AND e.day < c.since),
    roots AS (SELECT k, any_value(old) AS old, any_value(new) AS new, any_value(day) AS day,
      arg_min(root, since) AS root FROM chain GROUP BY k),
    facts AS (SELECT new AS ticker, day, 1 AS side, root FROM roots UNION ALL SELECT old, day, 0, root FROM roots),
    last AS (SELECT ticker, arg_max(side, (day, side)) AS side, arg_max(root, (day, side)) AS root FROM facts GROUP BY 1)
    """


@query("c24_rename_identity", RENAME + f"""SELECT l.ticker, CASE side WHEN 0 THEN 'renamed' ELSE 'active' END AS status,
    root AS ticker_canonical_id FROM last l WHERE side=1 OR l.ticker IN (SELECT ticker FROM after)
      OR l.ticker IN (SELECT new FROM edge)""")
def rename_identity(spark, d):
    changes = src.actions(spark, d).where("action_type = 'symbol_change'")
    out = ls.apply_renames(after(spark, d), changes)
    return out.where(F.col("ticker_canonical_id").isNotNull()).select(
        "ticker", "status", "ticker_canonical_id")


@query("l4_listing_lifecycle", RENAME + f"""SELECT a.ticker, {t('first_seen','first_seen')}, {t('last_seen','last_seen')},
    CASE WHEN l.side=0 THEN 'renamed' WHEN l.side=1 THEN 'active' ELSE status END AS status,
    l.root AS ticker_canonical_id FROM after a LEFT JOIN last l ON l.ticker=a.ticker""")
def listing_lifecycle(spark, d):
    """Transitions of the day, then renames, for every ticker on record."""
    changes = src.actions(spark, d).where("action_type = 'symbol_change'")
    known = after(spark, d)
    return ls.apply_renames(known, changes).join(known.select("ticker"), "ticker", "left_semi")


@query("g4_known_not_seen", f"""WITH known AS ({KNOWN}), seen AS ({SEEN}) SELECT ticker FROM known
    WHERE ticker NOT IN (SELECT ticker FROM seen)""")
def known_not_seen(spark, d):
    known = src.known_listings(spark, d, CUT).select("ticker")
    return known.join(seen(spark, d), "ticker", "left_anti")


