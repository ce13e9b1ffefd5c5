"""As-of joins, news, halts, corporate actions, outcomes and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import OutcomeRules, TradabilityRules
from tapeloom.functions import metrics as m
from tapeloom.functions import rules
from tapeloom.functions import timegrid as tg
from tapeloom.operators import bars as bar_ops
from tapeloom.operators import baseline, integrity, outcomes, research
from tapeloom.operators import news as news_ops
from tapeloom.operators.scan import asof_join, intervals_overlap, latest_rows
from tapeloom.sources import adapters as src
from tapeloom.suite.registry import (
    SESSION, et, et_instant, mins, pct, query, r, sod, t, with_,
)

FRESH = 1440  # minutes: the test stream is sparse
BAR = src.BAR_MINUTES
SILENT = 4 * BAR

# --- reference facts as known at a moment ----------------------------------

PROBES = """SELECT o_orderkey AS probe_id, 'C'||((o_custkey*7+1)%(SELECT count(*) FROM customer)) AS ticker,
    o_orderdate AS ts FROM orders"""


def probes(spark, d):
    """Orders look up another customer's facts."""
    size = src.table(spark, d, "customer").agg(F.count(F.lit(1))).scalar()
    return src.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("probe_id"),
        F.concat(F.lit("C"), ((F.col("o_custkey") * 7 + 1) % size).cast("string")).alias("ticker"),
        F.col("o_orderdate").cast("timestamp").alias("ts"))


@query("c1_asof_reference", with_("reference", f"""SELECT probe_id, {t('ts','ts')}, {t('seen_at','seen_at')},
    sector, {r('market_cap','market_cap')} FROM (SELECT p.*, r.seen_at, r.sector, r.market_cap,
      row_number() OVER (PARTITION BY probe_id ORDER BY r.seen_at DESC, r.o_orderkey DESC) AS rn
      FROM probes p LEFT JOIN reference r ON r.ticker=p.ticker AND r.seen_at<=p.ts) WHERE rn=1""",
      probes=PROBES))
def asof_reference(spark, d):
    found = asof_join(probes(spark, d), src.reference(spark, d), ["ticker"], "ts", "seen_at",
                      ["seen_at", "sector", "market_cap"], ["o_orderkey"], "month")
    return found.select("probe_id", "ts", "matched.seen_at", "matched.sector", "matched.market_cap")


@query("c2_latest_reference", with_("reference", f"""SELECT ticker, {t('seen_at','seen_at')}, sector,
    {r('market_cap','market_cap')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker
      ORDER BY seen_at DESC, o_orderkey DESC) AS rn FROM reference) WHERE rn=1"""))
def latest_reference(spark, d):
    return latest_rows(src.reference(spark, d), ["ticker"], ["seen_at", "o_orderkey"]).select(
        "ticker", "seen_at", "sector", "market_cap")


# --- news ------------------------------------------------------------------

NEWEST = """SELECT p.*, n.news_id, n.headline, n.created_at FROM (SELECT *, row_number() OVER () AS k FROM purchases) p
    ASOF LEFT JOIN tagged n ON n.ticker=p.ticker AND n.created_at<=p.ts"""
CLASS = f"""CASE WHEN created_at IS NULL THEN 'none' WHEN {mins('created_at','ts')} < 0 THEN 'stale'
    WHEN {mins('created_at','ts')} <= {{fresh}} THEN 'fresh' WHEN created_at >=
      CASE WHEN {sod('ts')} < 34200 THEN {et_instant("date - 1",'16:00')}
      ELSE {et_instant('date','04:00')} END THEN 'today' ELSE 'stale' END"""


def newest(spark, d, **kw):
    return news_ops.latest_news(src.purchases(spark, d), news_ops.by_symbol(src.news(spark, d)),
                                "ts", **kw)


@query("c3_asof_news", with_("purchases tagged", f"""SELECT event_id, ticker, news_id,
    {t('created_at','created_at')} FROM newest""", newest=NEWEST))
def asof_news(spark, d):
    return newest(spark, d).select("event_id", "ticker", "news.news_id", "news.created_at")


@query("c3_asof_news_received", with_("purchases tagged", """SELECT p.event_id, p.ticker,
    (SELECT arg_max(n.news_id, (n.created_at, n.news_id)) FROM tagged n WHERE n.ticker=p.ticker
      AND n.created_at<=p.ts AND n.received_at<=p.ts) AS news_id FROM purchases p"""))
def asof_news_received(spark, d):
    """Replay visibility: published and also received by the moment."""
    return newest(spark, d, received_too=True).select("event_id", "ticker", "news.news_id")


@query("c4_fresh_news", with_("purchases tagged", f"""SELECT event_id, CASE WHEN c='fresh' THEN news_id END
    AS news_id, c AS freshness FROM (SELECT *, {CLASS.format(fresh=FRESH)} AS c FROM newest)""",
    newest=NEWEST))
def fresh_news(spark, d):
    rows = news_ops.fresh_only(news_ops.with_freshness(newest(spark, d), "ts", FRESH))
    return rows.select("event_id", "news.news_id", "freshness")


@query("b21_freshness_class", with_("purchases tagged", f"""SELECT freshness, count(*) AS n FROM (
    SELECT {CLASS.format(fresh=15)} AS freshness FROM newest) GROUP BY 1""", newest=NEWEST))
def freshness_class(spark, d):
    rows = news_ops.with_freshness(newest(spark, d), "ts", 15)
    return rows.groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))


@query("b22_news_day_start", with_("purchases", f"""SELECT event_id, {t(f'''CASE WHEN {sod('ts')} < 34200
    THEN {et_instant("date - 1",'16:00')} ELSE {et_instant('date','04:00')} END''','starts_at')} FROM purchases"""))
def news_day_start(spark, d):
    return src.purchases(spark, d).select(
        "event_id", tg.news_day_start(F.col("ts")).alias("starts_at"))


@query("c5_first_news", with_("tagged", f"""SELECT ticker, {t(f"{et('created_at')}::DATE",'date')},
    {t('min(created_at)','first_news')}, arg_min(news_id, created_at) AS first_news_id
    FROM tagged GROUP BY ticker, {et('created_at')}::DATE"""))
def first_news(spark, d):
    return news_ops.first_news(news_ops.by_symbol(src.news(spark, d)))


@query("a15_news_rows", with_("news", f"""SELECT news_id, {t(f"{et('created_at')}::DATE",'date')},
    array_to_string(symbols,'|') AS symbols, headline, 'wire' AS news_source, NULL::VARCHAR AS url,
    {t('created_at','created_at_utc')}, NULL::VARCHAR AS updated_at_utc, {t('received_at','received_at_utc')},
    {r('(epoch_us(received_at)-epoch_us(created_at))/1000000.0::DOUBLE','feed_latency_s')},
    {t('received_at','written_at_utc')} FROM news"""))
def news_rows(spark, d):
    return news_ops.news_rows(src.news(spark, d))


@query("d40_feed_latency", with_("news", f"""SELECT {t(f"{et('created_at')}::DATE",'date')}, count(*) AS n,
    {r('avg(x)','mean_s')}, {r('min(x)','low_s')}, {r('max(x)','high_s')} FROM (SELECT *,
    (epoch_us(received_at)-epoch_us(created_at))/1000000.0::DOUBLE - 10 AS x FROM news)
    GROUP BY {et('created_at')}::DATE"""))
def feed_latency(spark, d):
    """A feed clock ten seconds ahead gives negative latencies, and they stay."""
    skewed = src.news(spark, d).withColumn("x", news_ops.latency_seconds() - 10)
    return skewed.groupBy(tg.et_date(F.col("created_at")).alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_s"), F.min("x").alias("low_s"),
        F.max("x").alias("high_s"))


@query("g3_dedup_union", with_("news", f"""SELECT news_id, {t('received_at','received_at')},
    CASE WHEN event_id%3=0 THEN 'backfill' ELSE 'stream' END AS arrived_by FROM (
      SELECT news_id, event_id, CASE WHEN event_id%3=0 THEN received_at - INTERVAL 5 SECOND ELSE received_at END
      AS received_at FROM news)"""))
def dedup_union(spark, d):
    """Stream and backfill overlap fully; the earlier copy of each article stays."""
    stream = src.news(spark, d).withColumn("arrived_by", F.lit("stream"))
    shift = F.when(F.col("event_id") % 3 == 0, -5_000_000).otherwise(60_000_000)
    backfill = src.news(spark, d).withColumns({
        "arrived_by": F.lit("backfill"),
        "received_at": F.timestamp_micros(F.unix_micros("received_at") + shift)})
    return news_ops.first_arrivals(stream, backfill).select("news_id", "received_at", "arrived_by")


# --- feed health -----------------------------------------------------------

OUTAGES = """SELECT day, ts AS started, (SELECT min(u.ts) FROM health u WHERE u.day=h.day AND u.state='up'
    AND u.ts > h.ts) AS ended FROM (SELECT *, lag(state) OVER (PARTITION BY day ORDER BY ts, event_id) AS prev
    FROM health) h WHERE state='down' AND prev IS DISTINCT FROM 'down'"""


@query("e16_outages", with_("health", f"""SELECT {t('day','day')}, {t('started','started')}, {t('ended','ended')}
    FROM outages""", outages=OUTAGES))
def outages(spark, d):
    return news_ops.outages(src.health(spark, d), ["day"])


@query("d38_outage_minutes", with_("health", f"""SELECT {t('day','day')},
    {r('sum(epoch_us(coalesce(ended, day + INTERVAL 1 DAY)) - epoch_us(started))/60000000.0::DOUBLE','disconnect_minutes')},
    count(ended) AS reconnects FROM outages GROUP BY day""", outages=OUTAGES))
def outage_minutes(spark, d):
    midnight = F.date_add(F.col("day"), 1).cast("timestamp")
    return news_ops.outage_minutes(
        news_ops.outages(src.health(spark, d), ["day"]).withColumn("_end", midnight),
        ["day"], F.col("_end"))


@query("d41_source_status", with_("ticks", f"""SELECT ticker AS source, {t('max(ts)','last_success')},
    {r("(epoch_us((SELECT max(ts) FROM ticks))-epoch_us(max(ts)))/1000000.0::DOUBLE",'age_seconds')},
    (epoch_us((SELECT max(ts) FROM ticks))-epoch_us(max(ts)))/1000000.0::DOUBLE <= 600 AS healthy
    FROM ticks GROUP BY ticker"""))
def source_status(spark, d):
    ticks = src.ticks(spark, d)
    now = ticks.agg(F.max("ts")).scalar()
    return news_ops.source_status(ticks.withColumnRenamed("ticker", "source"), now, 600.0)


# --- halts -----------------------------------------------------------------

GAPS = f"""SELECT ticker, date, minute, prev + INTERVAL {BAR} MINUTE AS halt_start, minute AS halt_end
    FROM (SELECT *, lag(minute) OVER (PARTITION BY ticker, date ORDER BY minute) AS prev FROM bars)
    WHERE {mins(f"prev + INTERVAL {BAR} MINUTE",'minute')} >= {SILENT}"""


@query("e8_inferred_halts", with_("bars", f"""SELECT ticker, {t('date','date')}, {t('halt_start','halt_start')},
    {t('halt_end','halt_end')}, true AS inferred FROM gaps""", gaps=GAPS))
def inferred_halts(spark, d):
    return integrity.infer_halts(src.bars(spark, d), SILENT, BAR)


@query("e8_regular_session_halts", with_("bars", f"""SELECT ticker, {t('date','date')},
    {t('halt_start','halt_start')}, {t('halt_end','halt_end')} FROM (SELECT ticker, date, minute,
      prev + INTERVAL {BAR} MINUTE AS halt_start, minute AS halt_end, prev FROM (SELECT *, lag(minute) OVER
      (PARTITION BY ticker, date ORDER BY minute) AS prev FROM bars)
      WHERE {mins(f"prev + INTERVAL {BAR} MINUTE",'minute')} >= {BAR})
    WHERE {sod('minute')} >= 34200 AND {sod('minute')} < 57600 AND {sod('prev')} >= 34200"""))
def regular_session_halts(spark, d):
    """Only silences between two regular-session bars, from one bar's length."""
    return integrity.infer_halts(src.bars(spark, d), BAR, BAR, {"regular": ("09:30", "16:00")}
                                 ).drop("inferred")


@query("d7_halt_summary", with_("bars", f"""SELECT ticker, {t('date','date')}, count(*) AS halt_count,
    {r(f"sum({mins('halt_start','halt_end')})",'halt_minutes')} FROM gaps GROUP BY ticker, date""", gaps=GAPS))
def halt_summary(spark, d):
    return integrity.halt_summary(integrity.infer_halts(src.bars(spark, d), SILENT, BAR))


@query("c9_interval_overlap", with_("bars purchases", f"""SELECT p.event_id, {t('p.ts','window_start')},
    EXISTS (SELECT 1 FROM gaps g WHERE g.halt_start < p.ts + INTERVAL 30 MINUTE AND p.ts < g.halt_end
      AND g.ticker='signup') AS overlaps FROM purchases p""", gaps=GAPS))
def interval_overlap(spark, d):
    """Half-hour windows after purchases against silences of the sign-up feed."""
    windows = src.purchases(spark, d).select(
        "event_id", F.lit("signup").alias("ticker"), F.col("ts").alias("window_start"),
        tg.plus_minutes(F.col("ts"), 30).alias("window_end"))
    halts = integrity.infer_halts(src.bars(spark, d), SILENT, BAR)
    return intervals_overlap(windows, halts, ["ticker"], ("window_start", "window_end"),
                             ("halt_start", "halt_end"), chunk_unit=None
                             ).select("event_id", "window_start", "overlaps")


@query("c10_point_in_interval", with_("bars purchases", """SELECT p.event_id, EXISTS (SELECT 1 FROM gaps g
    WHERE g.halt_start <= p.ts AND p.ts < g.halt_end AND g.ticker='signup') AS halted FROM purchases p""",
    gaps=GAPS))
def point_in_interval(spark, d):
    """Was the sign-up feed silent at the moment? Latest start, then containment."""
    halts = integrity.infer_halts(src.bars(spark, d), SILENT, BAR)
    points = src.purchases(spark, d).select("event_id", F.lit("signup").alias("ticker"), "ts")
    found = asof_join(points, halts, ["ticker"], "ts", "halt_start", ["halt_start", "halt_end"],
                      chunk_unit=None)
    inside = integrity.covers(F.col("ts"), F.col("matched.halt_start"), F.col("matched.halt_end"))
    return found.select("event_id", F.coalesce(inside, F.lit(False)).alias("halted"))


# --- corporate actions -----------------------------------------------------

DAYS = "SELECT DISTINCT ticker, date FROM evals"


def eval_days(spark, d):
    return src.evals(spark, d).select("ticker", "date").distinct()


@query("c7_action_on_day", with_("evals actions", f"""SELECT y.ticker, {t('y.date','date')}, action_type,
    {r('ratio','ratio')} FROM days y LEFT JOIN actions a ON a.ticker=y.ticker AND a.effective_date=y.date""",
    days=DAYS))
def action_on_day(spark, d):
    return integrity.action_on(eval_days(spark, d), src.actions(spark, d))


@query("c8_days_since_reverse_split", with_("evals actions", f"""SELECT y.ticker, {t('y.date','date')},
    (SELECT min(y.date - a.effective_date) FROM actions a WHERE a.ticker=y.ticker AND ratio < 1 AND
      action_type LIKE '%split' AND y.date - a.effective_date BETWEEN 0 AND 365)::BIGINT
    AS days_since_reverse_split FROM days y""", days=DAYS))
def days_since_reverse_split(spark, d):
    return integrity.days_since_reverse_split(eval_days(spark, d), src.actions(spark, d))


@query("b25_split_predicates", with_("actions", """SELECT action_type,
    action_type IN ('forward_split','reverse_split','split') AS is_split,
    coalesce(action_type IN ('forward_split','reverse_split','split') AND ratio<1,false) AS is_reverse,
    count(*) AS n FROM actions GROUP BY ALL"""))
def split_predicates(spark, d):
    kind, ratio = F.col("action_type"), F.col("ratio")
    return src.actions(spark, d).groupBy(
        "action_type", rules.is_split(kind).alias("is_split"),
        rules.is_reverse_split(kind, ratio).alias("is_reverse")).agg(F.count(F.lit(1)).alias("n"))


@query("b33_action_window", with_("evals actions", f"""SELECT {t('date','date')}, count(*) AS n FROM (
    SELECT DISTINCT date FROM evals) e JOIN actions a ON a.effective_date BETWEEN e.date - 1 AND e.date + 5
    GROUP BY date"""))
def action_window(spark, d):
    """Actions each collection day would fetch: yesterday to five days ahead."""
    days = src.evals(spark, d).select("date").distinct()
    spread = src.actions(spark, d).select(F.explode(F.sequence(
        F.date_sub("effective_date", 5), F.date_add("effective_date", 1))).alias("date"))
    counts = spread.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "date")


@query("d35_baselines_to_recompute", with_("actions", f"""SELECT DISTINCT ticker, {t('effective_date','date')}
    FROM actions WHERE action_type IN ('forward_split','reverse_split','split')"""))
def baselines_to_recompute(spark, d):
    return integrity.baselines_to_recompute(src.actions(spark, d))


SPLITS = """SELECT ticker, effective_date + 120*k AS effective_date, CASE k WHEN 1 THEN 2.0::DOUBLE
    ELSE ratio END AS ratio FROM (SELECT *, unnest([0,1,2]) AS k FROM actions WHERE ratio IS NOT NULL)"""


def splits(spark, d):
    """Three splits of each ticker that has one, 120 days apart."""
    first = src.actions(spark, d).where(F.col("ratio").isNotNull())
    each = first.select("ticker", "effective_date", "ratio", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return each.select(
        "ticker", F.date_add("effective_date", F.col("k") * 120).alias("effective_date"),
        F.when(F.col("k") == 1, 2.0).otherwise(F.col("ratio")).alias("ratio"))


@query("h7_split_adjustment", with_("evals actions", f"""SELECT l_orderkey, l_linenumber, l_partkey,
    {r('f','split_ratio')}, {r('rvol/f','adjusted_price')}, {r('l_quantity*f','adjusted_volume')}
    FROM (SELECT *, coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker=e.ticker
      AND s.effective_date > e.date), 1) AS f FROM evals e)""", splits=SPLITS))
def split_adjustment(spark, d):
    """All history on today's basis: later splits compound, rows without one keep their values."""
    ratio = F.col("split_ratio")
    # a row travels whole through the scan: only what is asked for goes in
    rows = src.evals(spark, d).select(
        "ticker", "date", "l_orderkey", "l_linenumber", "l_partkey", "rvol", "l_quantity")
    return integrity.split_ratio(rows, splits(spark, d)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "split_ratio",
        m.adjust_price(F.col("rvol"), ratio).alias("adjusted_price"),
        m.adjust_volume(F.col("l_quantity"), ratio).alias("adjusted_volume"))


@query("b16_suspect_price", with_("daily", f"""SELECT ticker, {t('date','date')}, coalesce(CASE
    WHEN prev_close > 1e-9 THEN abs(close/prev_close-1) > 0.5::DOUBLE AND NOT volume >= 4500 AND NOT dayofweek(date)=5
    END, false) AS suspect FROM daily"""))
def suspect_price(spark, d):
    """Heavy volume, or a Friday standing for a recorded action, excuses a move."""
    return src.daily(spark, d).select("ticker", "date", rules.suspect_price(
        F.col("close"), F.col("prev_close"), 0.5, F.col("volume") >= 4500,
        F.dayofweek("date") == 6).alias("suspect"))


# --- outcomes --------------------------------------------------------------

RULES = OutcomeRules(forward_minutes=(30, 60, 120, 240), tolerance_minutes=30)
TRADE = TradabilityRules(min_dollar_volume=8000.0, max_spread_pct=60.0, window_minutes=60)
WALLS = ", ".join(f"'{w}'" for w in RULES.reference_times)
REFS = f"""SELECT ticker, date, timezone('UTC', timezone('America/New_York', date + w::TIME)) AS ref,
    CASE WHEN w::TIME < TIME '11:00' THEN {et_instant('date','11:00')} ELSE {et_instant('date','20:00')} END AS until
    FROM (SELECT ticker, date, unnest([{WALLS}]) AS w FROM (SELECT DISTINCT ticker, date FROM bars))"""
FOLDED = f"""SELECT f.ticker, f.date, f.ref, f.until,
    arg_max(close, minute) FILTER (minute <= ref) AS price,
    {', '.join(f"arg_min(close, minute) FILTER (minute BETWEEN ref + INTERVAL {k} MINUTE AND ref + INTERVAL {k+30} MINUTE) AS p{k}" for k in RULES.forward_minutes)},
    arg_max(close, minute) FILTER (minute <= {et_instant('f.date','09:30')}) AS p_open,
    arg_max(close, minute) FILTER (minute <= {et_instant('f.date','11:00')}) AS p_late,
    arg_max(close, minute) FILTER (minute <= {et_instant('f.date','20:00')}) AS p_end,
    max(high) FILTER (minute BETWEEN ref AND until) AS hi, min(low) FILTER (minute BETWEEN ref AND until) AS lo,
    max(high) AS day_high, arg_min(minute, (-high, minute)) AS high_minute,
    sum(volume) FILTER (minute <= {et_instant('f.date','10:00')}) AS vol,
    sum(vwap*volume) FILTER (minute <= {et_instant('f.date','10:00')}) AS weighted,
    arg_max(close, minute) FILTER (minute <= {et_instant('f.date','10:00')}) AS p_check,
    sum(close*volume) FILTER (minute >= ref AND minute < ref + INTERVAL 60 MINUTE) AS dollars,
    avg((high-low)/((high+low)/2)*100) FILTER (minute >= ref AND minute < ref + INTERVAL 60 MINUTE) AS spread
    FROM refs f JOIN bars b ON b.ticker=f.ticker AND b.date=f.date GROUP BY ALL"""


def labels(spark, d):
    bars = integrity.with_gaps(src.bars(spark, d), SILENT, BAR)
    return outcomes.outcomes(bars, RULES, TRADE, src.daily(spark, d))


OUTCOME_SQL = f"""SELECT f.ticker, {t('f.date','date')}, {t('ref','reference_ts_utc')},
    {r('price','reference_price')}, {', '.join(r(pct(f'p{k}','price'), f'ret_{k}m_pct') for k in RULES.forward_minutes)},
    {r(f"CASE WHEN {et_instant('f.date','09:30')} > ref THEN {pct('p_open','price')} END",'ret_to_open_pct')},
    {r(f"CASE WHEN {et_instant('f.date','11:00')} > ref THEN {pct('p_late','price')} END",'ret_to_1100_pct')},
    {r(f"CASE WHEN {et_instant('f.date','20:00')} > ref THEN {pct('p_end','price')} END",'ret_to_close_pct')},
    {r(pct('hi','price'),'mfe_pct')}, {r(pct('lo','price'),'mae_pct')},
    {r(mins(et_instant('f.date','04:00'),'high_minute'),'minutes_to_high')},
    {r(pct('day_high','prev_close'),'high_of_day_pct')},
    CASE WHEN vol > 1e-9 THEN p_check > weighted/vol END AS held_above_vwap_1000,
    {r('dollars','dollar_volume_in_window')}, {r('spread','est_spread_pct')},
    coalesce(dollars >= 8000 AND spread <= 60, false) AS tradeable,
    EXISTS (SELECT 1 FROM gaps g WHERE g.ticker=f.ticker AND g.date=f.date AND g.halt_start < until
      AND ref < g.halt_end) AS spans_halt
    FROM folded f LEFT JOIN daily y ON y.ticker=f.ticker AND y.date=f.date"""


@query("d11_outcomes", with_("bars daily", OUTCOME_SQL, refs=REFS, folded=FOLDED, gaps=GAPS))
def outcome_rows(spark, d):
    """The whole label row: one aggregate per ticker-day and reference time."""
    return labels(spark, d)


def _subset(name, doc, spark_cols, sql_cols):
    @query(name, with_("bars daily", f"""SELECT f.ticker, {t('f.date','date')}, {t('ref','reference_ts')},
        {sql_cols} FROM folded f""", refs=REFS, folded=FOLDED))
    def run(spark, d):
        grid = bar_ops.reference_times(src.bars(spark, d), RULES.reference_times).withColumn(
            "until", outcomes.excursion_end(F.col("reference_ts"), RULES))
        return grid.groupBy("ticker", "date", "reference_ts").agg(*spark_cols())
    run.__doc__ = doc


def _ref():
    return F.col("reference_ts")


_subset("c11_price_at", "Last close at or before each reference time.",
        lambda: [outcomes.price_at(_ref()).alias("price")], r('price', 'price'))
_subset("c12_price_after", "First close within the tolerance after +60 minutes.",
        lambda: [outcomes.price_after(tg.plus_minutes(_ref(), 60), 30).alias("price_60m")],
        r('p60', 'price_60m'))


@query("d9_excursions", with_("bars daily", f"""SELECT f.ticker, {t('f.date','date')}, {t('ref','reference_ts')},
    {r(pct('hi','price'),'mfe_pct')}, {r(pct('lo','price'),'mae_pct')} FROM folded f""", refs=REFS, folded=FOLDED))
def excursions(spark, d):
    return labels(spark, d).select("ticker", "date", F.col("reference_ts_utc").alias("reference_ts"),
                                   "mfe_pct", "mae_pct")


@query("d10_held_above_vwap", with_("bars daily", f"""SELECT DISTINCT f.ticker, {t('f.date','date')},
    CASE WHEN vol > 1e-9 THEN p_check > weighted/vol END AS held FROM folded f""", refs=REFS, folded=FOLDED))
def held_above_vwap(spark, d):
    return labels(spark, d).select(
        "ticker", "date", F.col("held_above_vwap_1000").alias("held")).distinct()


@query("c21_poll_outcomes", with_("day_evals ubars", f"""SELECT l_orderkey, l_linenumber, l_partkey, p.ticker,
    {t('poll_ts','poll_ts')}, tier, {t('o.ref','reference_ts')}, {r(pct('o.p60','o.price'),'ret_60m_pct')},
    CASE WHEN o.ref IS NOT NULL THEN coalesce(dollars >= 8000 AND spread <= 60, false) END AS tradeable
    FROM spread_polls p ASOF LEFT JOIN folded o ON p.ticker=o.ticker AND p.date=o.date AND p.poll_ts <= o.ref""",
    bars="SELECT *, close AS vwap FROM ubars", refs=REFS, folded=FOLDED,
    spread_polls="""SELECT * REPLACE (date::TIMESTAMP + to_minutes(480 + ((l_orderkey*7 + l_linenumber*53)%720)::INT)
      AS poll_ts) FROM day_evals"""))
def poll_outcomes(spark, d):
    """Each poll with the label of the next reference time of its day: one row per poll."""
    minute = 480 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 53) % 720
    polls = src.day_evals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "ticker", "date", "tier",
        tg.plus_minutes(F.col("date").cast("timestamp"), minute).alias("poll_ts"))
    rows = outcomes.outcomes(src.user_bars(spark, d), RULES, TRADE)
    found = research.polls_with_outcome(polls, rows, ["reference_ts_utc", "ret_60m_pct", "tradeable"])
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "ticker", "poll_ts", "tier",
        F.col("outcome.reference_ts_utc").alias("reference_ts"), "outcome.ret_60m_pct", "outcome.tradeable")


@query("c13_reference_grid", with_("bars", f"""SELECT ticker, {t('date','date')}, {t('ref','reference_ts')}
    FROM refs WHERE ref <= TIMESTAMP '2024-01-20 14:10:00'""", refs=REFS))
def reference_grid(spark, d):
    """Reference times already past on 20 January at 14:10 UTC."""
    days = src.bars(spark, d).select("ticker", "date").distinct()
    now = F.lit("2024-01-20 14:10:00").cast("timestamp")
    return bar_ops.reference_times(days, RULES.reference_times, now)


TRADE_REASON = """CASE WHEN dollars IS NULL THEN 'NO_BARS' WHEN dollars < 8000 THEN 'THIN'
    WHEN spread IS NULL THEN 'NO_SPREAD' WHEN spread > 60 THEN 'WIDE' ELSE 'LIQUID' END"""


@query("b24_tradability", with_("bars", f"""SELECT f.ticker, {t('f.date','date')}, {t('ref','reference_ts')},
    {r('dollars','dollar_volume_in_window')}, {r('spread','est_spread_pct')},
    CASE WHEN dollars IS NULL THEN 'unavailable' ELSE 'estimated' END AS spread_source,
    coalesce(dollars >= 8000 AND spread <= 60, false) AS tradeable, {TRADE_REASON} AS reason FROM folded f""",
    refs=REFS, folded=FOLDED))
def tradability(spark, d):
    return integrity.assess_tradability(src.bars(spark, d), RULES.reference_times, TRADE)


@query("d8_post_reference_window", with_("bars", f"""SELECT f.ticker, {t('f.date','date')}, {t('ref','reference_ts')},
    {r('dollars','dollars')}, {r('spread','spread')} FROM folded f""", refs=REFS, folded=FOLDED))
def post_reference_window(spark, d):
    return integrity.assess_tradability(src.bars(spark, d), RULES.reference_times, TRADE).select(
        "ticker", "date", "reference_ts", F.col("dollar_volume_in_window").alias("dollars"),
        F.col("est_spread_pct").alias("spread"))


@query("c26_labels_with_day_facts", with_("bars daily", f"""SELECT f.ticker, {t('f.date','date')},
    {r('prev_close','prev_close')}, coalesce(halt_count,0) AS halt_count, count(*) AS labels FROM refs f
    LEFT JOIN daily y ON y.ticker=f.ticker AND y.date=f.date LEFT JOIN (SELECT ticker, date, count(*) AS halt_count
      FROM gaps GROUP BY 1,2) h ON h.ticker=f.ticker AND h.date=f.date
    GROUP BY f.ticker, f.date, prev_close, halt_count""", refs=REFS, gaps=GAPS))
def labels_with_day_facts(spark, d):
    rows = labels(spark, d).select("ticker", "date")
    halts = integrity.halt_summary(integrity.infer_halts(src.bars(spark, d), SILENT, BAR))
    facts = rows.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("labels")).join(
        src.daily(spark, d).select("ticker", "date", "prev_close"), ["ticker", "date"], "left").join(
        halts.select("ticker", "date", "halt_count"), ["ticker", "date"], "left")
    return facts.select("ticker", "date", "prev_close",
                        F.coalesce("halt_count", F.lit(0).cast("long")).alias("halt_count"), "labels")


@query("c6_previous_close", with_("sessions calendar", f"""SELECT w.ticker, {t('w.date','date')},
    {r('coalesce(u.close,b.close)','prev_close')}, CASE WHEN u.close IS NOT NULL THEN 'universe'
    WHEN b.close IS NOT NULL THEN 'bars' END AS close_source FROM (SELECT DISTINCT ticker, s.date, p.date AS prior
      FROM sessions s JOIN calendar c ON c.date=s.date JOIN calendar p ON p.ord=c.ord-1) w
    LEFT JOIN sessions u ON u.ticker=w.ticker AND u.date=w.prior AND u.session='regular' AND u.volume >= 1000
    LEFT JOIN sessions b ON b.ticker=w.ticker AND b.date=w.prior AND b.session='regular' AND b.ticker<>'view'"""))
def previous_close(spark, d):
    """Rollups exist for busy days only; the bar source lacks one ticker."""
    rolled = bar_ops.session_rollup(src.bars(spark, d))
    regular = rolled.where("session = 'regular'")
    return outcomes.previous_closes(
        rolled, src.calendar(spark, d), regular.where(F.col("volume") >= 1000),
        regular.where(F.col("ticker") != "view"))


# --- volume baselines ------------------------------------------------------

OFFSETS = (60, 245, 330, 480, 720, 960)
CURVE = f"""SELECT ticker, date, o AS minute_offset, coalesce(sum(volume) FILTER (off < o), 0) AS v FROM (
    SELECT ticker, date, volume, {mins(et_instant('date','04:00'),'minute')} AS off, unnest([{', '.join(map(str, OFFSETS))}]) AS o
    FROM bars) GROUP BY ALL"""
BASE = """SELECT a.ticker, a.date, a.minute_offset, avg(b.v) AS baseline_volume, count(b.v) AS days_used
    FROM (SELECT c.*, k.ord FROM curve c JOIN calendar k ON k.date=c.date) a
    JOIN (SELECT c.*, k.ord FROM curve c JOIN calendar k ON k.date=c.date) b
      ON b.ticker=a.ticker AND b.minute_offset=a.minute_offset AND b.ord BETWEEN a.ord-10 AND a.ord-1
    GROUP BY ALL HAVING avg(b.v) > 0"""


def base(spark, d):
    return baseline.baselines(lambda: src.bars(spark, d), src.calendar(spark, d), OFFSETS)


@query("d6_volume_baseline", with_("bars calendar", f"""SELECT ticker, {t('date','date')},
    minute_offset::BIGINT AS minute_offset, {r('baseline_volume','baseline_volume')}, days_used FROM base""",
    curve=CURVE, base=BASE))
def volume_baseline(spark, d):
    return base(spark, d)


@query("j2_injected_bar_source", with_("bars calendar", f"""SELECT ticker, {t('date','date')},
    minute_offset::BIGINT AS minute_offset, {r('baseline_volume','baseline_volume')}, days_used FROM base""",
    curve=CURVE.replace("FROM bars)", "FROM bars WHERE ticker<>'error')"), base=BASE))
def injected_bar_source(spark, d):
    """The bar source is any callable that returns bars."""
    def fetch():
        return src.bars(spark, d).where(F.col("ticker") != "error")
    return baseline.baselines(fetch, src.calendar(spark, d), OFFSETS)


@query("e18_cumulative_volume", with_("bars", f"""SELECT ticker, {t('date','date')}, minute_offset,
    {r('volume','volume')}, {r('sum(volume) OVER (PARTITION BY ticker, date ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)','volume_before')}
    FROM (SELECT *, floor({mins(et_instant('date','04:00'),'minute')})::BIGINT AS minute_offset FROM bars)"""))
def cumulative_volume(spark, d):
    return baseline.cumulative_volume(src.bars(spark, d))


STORED = "SELECT *, baseline_volume*2 AS doubled FROM base WHERE minute_offset IN (245, 480)"


@query("c18_baseline_lookup", with_("bars calendar ticks", f"""SELECT event_id, minute_offset, origin,
    {r('v','baseline_volume')} FROM (SELECT t.event_id, t.minute_offset, coalesce(s.doubled, b.baseline_volume) AS v,
      CASE WHEN s.doubled IS NOT NULL THEN 'cached' WHEN b.baseline_volume IS NOT NULL THEN 'computed'
      ELSE 'none' END AS origin FROM (SELECT event_id, ticker, date,
        greatest(0,floor({mins(et_instant('date','04:00'),'ts')}))::BIGINT AS minute_offset FROM ticks) t
      LEFT JOIN stored s ON s.ticker=t.ticker AND s.date=t.date AND s.minute_offset=t.minute_offset
      LEFT JOIN base b ON b.ticker=t.ticker AND b.date=t.date AND b.minute_offset=t.minute_offset)""",
    curve=CURVE, base=BASE, stored=STORED))
def baseline_lookup(spark, d):
    """Cached figures are doubled here so that their origin shows."""
    fresh = base(spark, d)
    stored = fresh.where(F.col("minute_offset").isin(245, 480)).withColumn(
        "baseline_volume", F.col("baseline_volume") * 2)
    return baseline.lookup(src.ticks(spark, d), stored, fresh, "ts").select(
        "event_id", "minute_offset", "origin", "baseline_volume")


@query("f12_baseline_upsert", with_("bars calendar", f"""SELECT ticker, {t('date','date')},
    minute_offset::BIGINT AS minute_offset, {r("CASE WHEN minute_offset < 400 THEN baseline_volume ELSE baseline_volume*2 END",'baseline_volume')}
    FROM base""", curve=CURVE, base=BASE))
def baseline_upsert(spark, d):
    """Early offsets were recomputed later than the stored rows."""
    now = F.lit("2024-02-01").cast("timestamp")
    fresh = base(spark, d).withColumn("computed_at", now)
    stored = fresh.withColumns({
        "baseline_volume": F.col("baseline_volume") * 2,
        "computed_at": F.when(F.col("minute_offset") < 400, F.lit("2024-01-31").cast("timestamp"))
        .otherwise(F.lit("2024-02-02").cast("timestamp"))})
    return baseline.upsert(stored, fresh).select(*baseline.KEY, "baseline_volume")


@query("i12_baseline_invalidation", with_("bars calendar", f"""SELECT ticker, {t('date','date')},
    minute_offset::BIGINT AS minute_offset, {r('baseline_volume','baseline_volume')} FROM base
    WHERE NOT (ticker='view' AND date >= DATE '2024-01-15')""", curve=CURVE, base=BASE))
def baseline_invalidation(spark, d):
    stored = base(spark, d)
    split = stored.where((F.col("ticker") == "view") & (F.col("date") >= "2024-01-15")).select(
        "ticker", F.lit("forward_split").alias("action_type"), F.lit(2.0).alias("ratio"),
        F.col("date").alias("effective_date"))
    return baseline.invalidate(stored, integrity.baselines_to_recompute(split)).select(
        *baseline.KEY, "baseline_volume")
