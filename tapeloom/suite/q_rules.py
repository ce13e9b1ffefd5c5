"""Rules, tiers, ranks, pushes, collection and what-ifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import (
    CollectionRules,
    IntegrityRules,
    OutcomeRules,
    PillarThresholds,
    PushRules,
    RankWeights,
)
from tapeloom.functions import metrics as m
from tapeloom.functions import rules, text
from tapeloom.operators import collect, push, whatif
from tapeloom.operators import evaluations as ev
from tapeloom.operators.scan import percentile_ranks, places
from tapeloom.sources import adapters as src
from tapeloom.suite.registry import half_even, pct, query, r, t, with_

TH = PillarThresholds()
EVAL_ORDER = ["poll_ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
EVAL_KEY = "l_orderkey, l_linenumber, l_partkey"


# --- the five rules --------------------------------------------------------

def _pillar_query(name, number, value):
    column = f"p{number}"
    sql = with_("statuses", f"""SELECT {column} AS status, count(*) AS n, count({value}) AS n_value,
        {r(f'min({value})', 'low')}, {r(f'max({value})', 'high')} FROM statuses GROUP BY 1""")

    @query(name, sql)
    def run(spark, d):
        return src.scored(spark, d).groupBy(F.col(column).alias("status")).agg(
            F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"),
            F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


_pillar_query("b4_up_on_day", 1, "gap_pct")
_pillar_query("b5_relative_volume", 2, "rvol")
_pillar_query("b6_news_catalyst", 3, "news_age")
_pillar_query("b7_price_range", 4, "price")
_pillar_query("b8_float", 5, "float_shares")


@query("b9_all_pillars", with_("scored", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')},
    p1||'|'||p2||'|'||p3||'|'||p4||'|'||p5 AS statuses, passed::BIGINT AS passed,
    unknown::BIGINT AS unknown FROM scored"""))
def all_pillars(spark, d):
    c = F.col
    results = rules.pillar_structs(c("gap_pct"), c("rvol"), c("news_age"), c("price"),
                                   c("float_shares"), c("confidence"), TH)
    return src.evals(spark, d).withColumn("results", results).select(
        "l_orderkey", "l_linenumber", "l_partkey", "poll_ts",
        F.concat_ws("|", F.transform("results", lambda p: p["status"])).alias("statuses"),
        F.size(F.filter("results", lambda p: p["status"] == "pass")).alias("passed"),
        F.size(F.filter("results", lambda p: p["status"] == "unknown")).alias("unknown"))


@query("b10_feed_outage_override", with_("statuses", f"""SELECT p3 AS status, count(*) AS n,
    count(*) FILTER (detail='FEED_DOWN') AS n_outage,
    count(*) FILTER (detail='NO_FRESH_NEWS') AS n_quiet FROM (
      SELECT CASE WHEN confidence='low' THEN 'unknown' ELSE p3 END AS p3,
      CASE WHEN confidence='low' THEN 'FEED_DOWN'
           WHEN news_age IS NULL THEN 'NO_FRESH_NEWS' END AS detail FROM statuses)
    GROUP BY 1"""))
def feed_outage_override(spark, d):
    """Line 7 stands for polls during an outage: the catalyst is unknown there."""
    c = F.col
    results = rules.pillar_structs(
        c("gap_pct"), c("rvol"), c("news_age"), c("price"), c("float_shares"), c("confidence"), TH,
        feed_healthy=c("confidence") != "low")
    third = src.evals(spark, d).select(F.element_at(results, 3).alias("p"))
    return third.groupBy(c("p.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("p.detail") == "FEED_DOWN").alias("n_outage"),
        F.count_if(c("p.detail") == "NO_FRESH_NEWS").alias("n_quiet"))


@query("b11_near_miss", with_("statuses", """SELECT number, count(*) AS n,
    count(*) FILTER (status='fail' AND abs(value-threshold)/abs(threshold) <= 0.2::DOUBLE) AS n_near,
    count(*) FILTER (status='fail' AND CASE WHEN number=4 AND value<2 THEN abs(value-2)/2
      ELSE abs(value-threshold)/abs(threshold) END <= 0.2::DOUBLE) AS n_near_bound FROM (SELECT 1 AS number, p1 AS status, gap_pct::DOUBLE AS value, 10::DOUBLE AS threshold FROM statuses
      UNION ALL SELECT 2, p2, rvol, 5 FROM statuses UNION ALL SELECT 3, p3, news_age, 15 FROM statuses
      UNION ALL SELECT 4, p4, price, 20 FROM statuses
      UNION ALL SELECT 5, p5, float_shares, 20000000 FROM statuses) GROUP BY 1"""))
def near_miss(spark, d):
    c = F.col
    results = rules.pillar_structs(c("gap_pct"), c("rvol"), c("news_age"), c("price"),
                                   c("float_shares"), c("confidence"), TH)
    rows = src.evals(spark, d).select(F.inline(results))
    hit = rules.near_miss(c("status"), c("value"), c("threshold"), 0.2)
    low = F.when(c("number") == 4, F.lit(float(TH.price_min)))
    at_bound = rules.near_miss(c("status"), c("value"), c("threshold"), 0.2, low)
    return rows.groupBy("number").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_near"),
        F.count_if(at_bound).alias("n_near_bound"))


@query("b12_tiers", with_("scored", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')},
    CASE WHEN tier IN ('A','B') THEN tier WHEN was_runner AND p1='pass' THEN 'watch' ELSE tier END
    AS tier FROM scored"""))
def tiers(spark, d):
    statuses = [F.col(f"p{i}") for i in range(1, 6)]
    return src.scored(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "poll_ts",
        rules.tier(statuses, F.col("was_runner")).alias("tier"))


@query("b13_tier_upgrade", with_("scored", """SELECT previous, tier, (CASE tier WHEN 'A' THEN 3 WHEN 'B'
    THEN 2 WHEN 'watch' THEN 1 ELSE 0 END > CASE previous WHEN 'A' THEN 3 WHEN 'B' THEN 2
    WHEN 'watch' THEN 1 ELSE 0 END) AS upgrade, count(*) AS n FROM (SELECT *,
      CASE WHEN was_runner AND p1='pass' AND tier='none' THEN 'watch' ELSE 'none' END AS previous FROM scored)
    GROUP BY ALL"""))
def tier_upgrade(spark, d):
    previous = F.when(F.col("was_runner") & (F.col("p1") == "pass") & (F.col("tier") == "none"),
                      "watch").otherwise("none")
    rows = src.scored(spark, d).withColumn("previous", previous)
    return rows.groupBy("previous", "tier",
                        rules.is_upgrade(F.col("previous"), F.col("tier")).alias("upgrade")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b14_threshold_predicate", with_("evals", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')}
    FROM evals WHERE gap_pct >= 10 AND rvol >= 5 AND price BETWEEN 2 AND 20 AND float_shares < 20000000
    AND coalesce(news_age BETWEEN 0 AND 15, false)"""))
def threshold_predicate(spark, d):
    had_news = F.coalesce(F.col("news_age").between(0, 15), F.lit(False))
    return src.evals(spark, d).where(rules.passes(
        F.col("gap_pct"), F.col("rvol"), F.col("price"), F.col("float_shares"), had_news, TH)
    ).select("l_orderkey", "l_linenumber", "l_partkey", "poll_ts")


@query("b23_float_confidence", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')}, CASE
    WHEN float_shares IS NULL THEN 'low' WHEN volume*1e5::DOUBLE/float_shares > 10 THEN 'low'
    WHEN user_id%3=0 THEN 'medium' WHEN date_diff('day', TIMESTAMP '2023-10-20 00:00:00', poll_ts) > 90
    THEN 'low' ELSE 'high' END AS confidence FROM polls"""))
def float_confidence(spark, d):
    """As-of dates are known for two users in three."""
    shares = F.col("float_shares")
    asof = F.when(F.col("user_id") % 3 != 0, F.lit("2023-10-20").cast("timestamp"))
    return src.polls(spark, d).select("ticker", "poll_ts", m.float_confidence(
        shares, m.float_turnover(F.col("volume") * 1e5, shares), asof, F.col("poll_ts"),
        10.0, 90).alias("confidence"))


@query("b26_bar_scope", with_("scored", f"""SELECT {t('date','date')}, ticker,
    {r('max(greatest(coalesce(gap_pct,0),0))','change_pct')} FROM scored
    WHERE gap_pct >= 10 OR tier IN ('watch','B','A') GROUP BY date, ticker"""))
def bar_scope(spark, d):
    return ev.bar_scope(src.scored(spark, d), OutcomeRules())


@query("f2_scope_cap", with_("scored", f"""SELECT {t('date','date')}, ticker,
    {r('change_pct','change_pct')}, rk <= 3 AS kept FROM (SELECT *, row_number() OVER
      (PARTITION BY date ORDER BY change_pct DESC, ticker) AS rk FROM (
        SELECT date, ticker, max(greatest(coalesce(gap_pct,0),0)) AS change_pct FROM scored
        WHERE gap_pct >= 10 OR tier IN ('watch','B','A') GROUP BY date, ticker))"""))
def scope_cap(spark, d):
    kept, skipped = ev.split_scope(ev.bar_scope(src.scored(spark, d), OutcomeRules()), 3)
    return kept.drop("rank").withColumn("kept", F.lit(True)).unionByName(
        skipped.withColumn("kept", F.lit(False)))


@query("b27_fallback_feed", with_("statuses", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')}
    FROM statuses WHERE confidence='low' AND p1='pass' AND p4='pass' AND float_shares < 20000000"""))
def fallback_feed(spark, d):
    rows = src.scored(spark, d)
    fifth = rules.small_float(F.col("float_shares"), F.lit("medium"), TH)
    return rows.where(rules.use_fallback_feed(
        F.col("confidence") != "low", F.col("p1"), F.col("p4"), fifth, True)
    ).select("l_orderkey", "l_linenumber", "l_partkey", "poll_ts")


# --- reductions of evaluations --------------------------------------------

@query("d12_best_tier", with_("scored", f"""SELECT ticker, {t('date','date')},
    ['none','watch','B','A'][max(k)+1] AS best_tier, {t('arg_min(poll_ts, (-k, poll_ts))','best_tier_ts')}
    FROM (SELECT *, CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS k FROM scored)
    GROUP BY ticker, date"""))
def best_tier(spark, d):
    return ev.best_tier(src.scored(spark, d))


@query("d13_evaluation_summary", with_("scored", f"""SELECT s.ticker, {t('s.date','date')},
    p1||'|'||p2||'|'||p3||'|'||p4||'|'||p5 AS statuses, {r('gap_pct','latest_gap_pct')},
    {r('rvol','latest_rvol')}, b.best_tier FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date
      ORDER BY poll_ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS rn
      FROM scored) s JOIN (SELECT ticker, date, ['none','watch','B','A'][max(CASE tier WHEN 'A' THEN 3
      WHEN 'B' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END)+1] AS best_tier FROM scored GROUP BY 1,2) b
    ON b.ticker=s.ticker AND b.date=s.date WHERE rn=1"""))
def evaluation_summary(spark, d):
    out = ev.evaluation_summary(src.scored(spark, d), TH, EVAL_ORDER)
    return out.select(
        "ticker", "date",
        F.concat_ws("|", F.transform("pillars", lambda p: p["status"])).alias("statuses"),
        F.col("pillars")[0]["value"].alias("latest_gap_pct"),
        F.col("pillars")[1]["value"].alias("latest_rvol"), "best_tier")


@query("d27_tier_counts", with_("scored", f"""SELECT {t('poll_ts','poll_ts')},
    count(*) FILTER (tier='none') AS n_none, count(*) FILTER (tier='watch') AS n_watch,
    count(*) FILTER (tier='B') AS n_b, count(*) FILTER (tier='A') AS n_a FROM scored GROUP BY poll_ts"""))
def tier_counts(spark, d):
    return ev.tier_counts(src.scored(spark, d))


# --- ranks -----------------------------------------------------------------

def rank_sql(value, by):
    """Tie-averaged percentile rank as an expression over a window."""
    return f"""CASE WHEN {value} IS NULL THEN NULL WHEN count({value}) OVER (PARTITION BY {by}) = 1 THEN 1.0::DOUBLE
      ELSE (rank() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST) - 1
        + (count(*) OVER (PARTITION BY {by}, {value}) - 1)/2.0::DOUBLE)
        / (count({value}) OVER (PARTITION BY {by}) - 1) END"""


@query("e6_percentile_rank", with_("evals", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')},
    {r(rank_sql('rvol','date'),'rvol_rank')}, {r(rank_sql('news_age','date'),'news_rank')} FROM evals"""))
def percentile_rank(spark, d):
    out = percentile_ranks(src.evals(spark, d), ["date"],
                           {"rvol": "rvol_rank", "news_age": "news_rank"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "poll_ts", "rvol_rank", "news_rank")


SCORE_SQL = """CASE WHEN a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL THEN
    (coalesce(a*0.5::DOUBLE,0)+coalesce(b*0.3::DOUBLE,0)+coalesce(c*0.2::DOUBLE,0))
    /((a IS NOT NULL)::INT*0.5::DOUBLE+(b IS NOT NULL)::INT*0.3::DOUBLE+(c IS NOT NULL)::INT*0.2::DOUBLE) END"""


@query("e7_rank_score", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')}, {r(SCORE_SQL,'rank_score')}
    FROM (SELECT ticker, poll_ts, NULL::DOUBLE AS a, {rank_sql('float_shares','poll_ts')} AS b,
      {rank_sql('change_pct','poll_ts')} AS c FROM polls)"""))
def rank_score(spark, d):
    """No window move known; float stands in for volume rank, where present."""
    ranked = percentile_ranks(src.polls(spark, d), ["poll_ts"],
                              {"float_shares": "b", "change_pct": "c"})
    score = m.rank_score(F.lit(None).cast("double"), F.col("b"), F.col("c"), RankWeights())
    return ranked.select("ticker", "poll_ts", score.alias("rank_score"))


# --- pushes ----------------------------------------------------------------

PUSH_TIES = "l_orderkey, l_linenumber, l_partkey"
PUSH_CTE = f"""SELECT *, CASE WHEN tier NOT IN ('A','B') THEN 'TIER_NOT_SENT'
    WHEN sent_before >= p THEN 'SENT_BEFORE:'||CASE sent_before WHEN 3 THEN 'A' ELSE 'B' END
    WHEN pushed AND sent_before=2 THEN 'UPGRADE:B' WHEN pushed THEN 'FIRST'
    ELSE 'BUDGET_SPENT:3' END AS push_reason FROM (
  SELECT *, coalesce(max(CASE WHEN pushed THEN p END) OVER (PARTITION BY window_start, brand
    ORDER BY poll_ts, -l_quantity, brand, {PUSH_TIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)
    AS sent_before FROM (
   SELECT *, eligible AND sum(eligible::INT) OVER (PARTITION BY window_start ORDER BY poll_ts,
     -l_quantity, brand, {PUSH_TIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3 AS pushed FROM (
    SELECT *, p > coalesce(max(p) OVER (PARTITION BY window_start, brand ORDER BY poll_ts, -l_quantity,
      brand, {PUSH_TIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS eligible FROM (
     SELECT *, CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 0 END AS p FROM scored))))"""


def pushed_evals(spark, d):
    rows = src.evaluations(spark, d).withColumn("ticker", F.col("brand"))
    return push.decide_pushes(rows, PushRules(max_pushes=3), score="l_quantity",
                              ties=["l_orderkey", "l_linenumber", "l_partkey"])


@query("e12_push_decision", with_("scored", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')}, pushed,
    push_reason FROM decided""", decided=PUSH_CTE))
def push_decision(spark, d):
    return pushed_evals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "poll_ts", "pushed", "push_reason")


@query("e17_alert_upsert", with_("scored", f"""SELECT alert_id, brand AS ticker,
    {t('max(poll_ts)','poll_ts')}, {r('arg_max(gap_pct,(poll_ts,l_orderkey,l_linenumber,l_partkey))','gap_pct')},
    bool_or(pushed) AS pushed, {t('min(poll_ts)','first_poll_ts')} FROM (SELECT *,
      strftime(date,'%Y-%m-%d')||'-'||strftime(window_start,'%H%M')||'-'||brand||'-'||tier AS alert_id
      FROM decided WHERE tier IN ('A','B')) GROUP BY 1, 2""", decided=PUSH_CTE))
def alert_upsert(spark, d):
    return ev.alert_history(pushed_evals(spark, d),
                            ["poll_ts", "l_orderkey", "l_linenumber", "l_partkey"]).select(
        "alert_id", "ticker", "poll_ts", "gap_pct", "pushed", "first_poll_ts")


@query("k6_alert_history", with_("scored", f"""SELECT {t('date','date')}, tier, count(*) AS alerts,
    count(*) FILTER (pushed) AS pushed FROM (SELECT date, brand, tier, window_start, bool_or(pushed) AS pushed
      FROM decided WHERE tier IN ('A','B') GROUP BY ALL) GROUP BY date, tier""", decided=PUSH_CTE))
def alert_history(spark, d):
    kept = ev.alert_history(pushed_evals(spark, d),
                            ["poll_ts", "l_orderkey", "l_linenumber", "l_partkey"])
    return kept.groupBy("date", "tier").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if("pushed").alias("pushed"))


@query("f3_push_order", with_("scored", f"""SELECT {EVAL_KEY}, {t('window_start','window_start')}, {r('score','score')},
    row_number() OVER (PARTITION BY window_start ORDER BY coalesce(score,-1) DESC, brand, {PUSH_TIES}) AS place
    FROM (SELECT *, CASE WHEN confidence<>'low' THEN l_quantity END AS score FROM scored)"""))
def push_order(spark, d):
    """The order every row of a window competes in; a NULL score ranks last."""
    # rows are written between the shuffles: only what is asked for travels
    rows = src.evals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "window_start", "brand",
        F.when(F.col("confidence") != "low", F.col("l_quantity")).alias("score"))
    return places(rows, ["window_start"], F.coalesce("score", F.lit(-1.0)),
                  ["brand", "l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "window_start", "score", "place")


@query("f7_alerts_newest_first", with_("scored", f"""SELECT {t('date','date')}, alert_id, {t('last','last_poll_ts')}
    FROM (SELECT strftime(date,'%Y-%m-%d')||'-'||strftime(window_start,'%H%M')||'-'||brand||'-'||tier AS alert_id,
      date, max(poll_ts) AS last FROM decided WHERE tier IN ('A','B') GROUP BY ALL) x
    ORDER BY x.date, x.last DESC, alert_id""", decided=PUSH_CTE))
def alerts_newest_first(spark, d):
    """Alerts of every day, newest first."""
    kept = ev.alert_history(pushed_evals(spark, d), ["poll_ts", "l_orderkey"])
    return kept.orderBy("date", F.desc("poll_ts"), "alert_id").select(
        "date", "alert_id", F.col("poll_ts").alias("last_poll_ts"))


# --- scalar metrics --------------------------------------------------------

@query("h1_pct_change", with_("daily", f"""SELECT ticker, {t('date','date')},
    {r(pct('close','prev_close'),'change_pct')} FROM daily"""))
def pct_change(spark, d):
    return src.daily(spark, d).select(
        "ticker", "date", m.pct_change(F.col("close"), F.col("prev_close")).alias("change_pct"))


@query("h2_gap_with_fallback", with_("daily", f"""SELECT ticker, {t('date','date')},
    {r(f"coalesce({pct('open','prev_close')}, {pct('close','open')})",'gap_pct')} FROM daily"""))
def gap_with_fallback(spark, d):
    feed = m.pct_change(F.col("close"), F.col("open"))
    return src.daily(spark, d).select(
        "ticker", "date", m.gap_pct(F.col("open"), F.col("prev_close"), feed).alias("gap_pct"))


@query("h3_resolve_rvol", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {r('CASE WHEN user_id%2=0 THEN volume/100 WHEN user_id%5<>0 THEN volume/(average_volume_10d*0.05::DOUBLE) END','rvol')},
    CASE WHEN user_id%2=0 THEN 'baseline' WHEN user_id%5<>0 THEN 'fallback' ELSE 'unknown' END AS rvol_source
    FROM polls"""))
def resolve_rvol(spark, d):
    """Even users have a baseline; every fifth odd one lacks an average too."""
    uid = F.col("user_id")
    value, source = m.resolve_rvol(
        F.col("volume"), F.when(uid % 2 == 0, 100.0),
        F.when(uid % 5 != 0, F.col("average_volume_10d")), 0.05)
    return src.polls(spark, d).select(
        "ticker", "poll_ts", value.alias("rvol"), source.alias("rvol_source"))


@query("h4_float_turnover", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {r('volume*1000/float_shares','turnover')} FROM polls"""))
def float_turnover(spark, d):
    return src.polls(spark, d).select("ticker", "poll_ts", m.float_turnover(
        F.col("volume") * 1000, F.col("float_shares")).alias("turnover"))


@query("h5_dollar_volume", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {r('price*volume','dollar_volume')} FROM polls"""))
def dollar_volume(spark, d):
    return src.polls(spark, d).select(
        "ticker", "poll_ts", m.dollar_volume(F.col("price"), F.col("volume")).alias("dollar_volume"))


@query("h6_expected_volume", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {r('average_volume_10d*0.05::DOUBLE','expected')} FROM polls"""))
def expected_volume(spark, d):
    return src.polls(spark, d).select("ticker", "poll_ts", m.expected_volume(
        F.col("average_volume_10d"), 0.05).alias("expected"))


@query("h13_alert_id", with_("scored", """SELECT strftime(date,'%Y-%m-%d')||'-'||
    strftime(window_start,'%H%M')||'-'||ticker||'-'||tier AS alert_id, count(*) AS n
    FROM scored WHERE tier IN ('A','B') GROUP BY 1"""))
def alert_id(spark, d):
    rows = src.scored(spark, d).where(F.col("tier").isin("A", "B"))
    key = text.alert_id(F.col("date"), F.col("window_start"), F.col("ticker"), F.col("tier"))
    return rows.groupBy(key.alias("alert_id")).agg(F.count(F.lit(1)).alias("n"))


@query("h14_push_text", with_("scored", f"""SELECT {EVAL_KEY}, {t('poll_ts','poll_ts')},
    '['||tier||'] '||ticker||' '||printf('%+.0f', round_even(gap_pct,0))||'% | RVOL '||
    {half_even('rvol',0)}||'x | '||coalesce('Float '||{half_even('float_shares/1000000',1)}||'M','Float ?')
    ||' | $'||{half_even('price',2)}||' — '||CASE WHEN p3='pass' THEN 'fresh '||brand ELSE
    'no fresh catalyst' END AS line FROM scored WHERE tier IN ('A','B')"""))
def push_text(spark, d):
    rows = src.scored(spark, d).where(F.col("tier").isin("A", "B"))
    headline = F.when(F.col("p3") == "pass", F.concat(F.lit("fresh "), F.col("brand")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "poll_ts", text.push_text(
        F.col("tier"), F.col("ticker"), F.col("gap_pct"), F.col("rvol"), F.col("float_shares"),
        F.col("price"), headline).alias("line"))


@query("h15_number_format", f"""SELECT o_orderkey, CASE WHEN x IS NULL THEN '—'
    WHEN abs(x)>=1000000 THEN {half_even('x/1000000',1)}||'M' WHEN abs(x)>=1000 THEN
    {half_even('x/1000',1)}||'k' ELSE {half_even('x',2)} END AS number,
    CASE WHEN x IS NULL THEN '—' ELSE printf('%+.1f', round_even(x/10000,1))||'%' END AS percent
    FROM (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice*37
      WHEN 2 THEN -o_totalprice/1000 END AS x FROM orders)""")
def number_format(spark, d):
    key = F.col("o_orderkey") % 4
    price = F.col("o_totalprice")
    x = F.when(key == 0, price).when(key == 1, price * 37).when(key == 2, -price / 1000)
    return src.table(spark, d, "orders").select(
        "o_orderkey", text.number(x).alias("number"), text.percent(x / 10000).alias("percent"))


# --- collection ------------------------------------------------------------

LABELLED = """SELECT p.*, CASE WHEN price < 5 THEN 'below_price_floor'
    WHEN abs(change_pct) >= 60 THEN 'abs_change'
    WHEN volume >= 2*(average_volume_10d*0.05::DOUBLE) THEN 'volume_ratio'
    WHEN rk <= 4 THEN 'top_dollar_volume' ELSE 'no_rule_matched' END AS rule
    FROM (SELECT *, row_number() OVER (PARTITION BY poll_ts ORDER BY price*volume DESC, ticker) AS rk
          FROM polls) p"""
COLLECT = CollectionRules(min_abs_change_pct=60.0, min_volume_ratio=2.0, top_dollar_volume_n=4,
                          min_price=5.0)


@query("b3_collection_filter", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')}, rule,
    rule NOT IN ('below_price_floor','no_rule_matched') AS collected FROM labelled""", labelled=LABELLED))
def collection_filter(spark, d):
    return collect.label_rules(src.polls(spark, d), COLLECT).select(
        "ticker", "poll_ts", "rule", "collected")


@query("f1_top_dollar_volume", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')}, rk AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY poll_ts ORDER BY price*volume DESC, ticker) AS rk
    FROM polls) WHERE rk <= 10"""))
def top_dollar_volume(spark, d):
    return collect.top_dollar_volume(src.polls(spark, d), 10).select("ticker", "poll_ts", "rank")


@query("d28_collection_stats", with_("polls", f"""SELECT {t('poll_ts','poll_ts')}, count(*) AS considered,
    count(*) FILTER (rule NOT IN ('below_price_floor','no_rule_matched')) AS collected,
    count(*) FILTER (rule='below_price_floor') AS below_price_floor,
    count(*) FILTER (rule='abs_change') AS abs_change, count(*) FILTER (rule='volume_ratio') AS volume_ratio,
    count(*) FILTER (rule='top_dollar_volume') AS top_dollar_volume,
    count(*) FILTER (rule='no_rule_matched') AS no_rule_matched FROM labelled GROUP BY poll_ts""",
    labelled=LABELLED))
def collection_stats(spark, d):
    return collect.collection_stats(collect.label_rules(src.polls(spark, d), COLLECT))


MOVED = """SELECT p.*, first_value(price) OVER w AS open_price, first_value(volume) OVER w AS open_volume
    FROM (SELECT *, date_trunc('day', poll_ts) + to_hours((hour(poll_ts)//4)*4) AS window_start FROM polls) p
    WINDOW w AS (PARTITION BY ticker, window_start ORDER BY poll_ts)"""


def four_hours(ts):
    """Four-hour windows of the poll grid."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 14400) * 14400)


@query("e9_window_baseline", with_("polls", f"""SELECT ticker, {t('window_start','window_start')},
    {t('min(poll_ts)','opened_at')}, {r('arg_min(price,poll_ts)','open_price')},
    {r('arg_min(volume,poll_ts)','open_volume')} FROM moved GROUP BY ticker, window_start""", moved=MOVED))
def window_baseline(spark, d):
    polls = src.polls(spark, d).withColumn("window_start", four_hours(F.col("poll_ts")))
    return collect.window_baselines(polls)


@query("e10_window_change", with_("polls", f"""SELECT ticker, {t('poll_ts','poll_ts')},
    {r(pct('price','open_price'),'window_change_pct')},
    {r('greatest(volume-open_volume,0)','window_volume')} FROM moved""", moved=MOVED))
def window_change(spark, d):
    polls = src.polls(spark, d).withColumn("window_start", four_hours(F.col("poll_ts")))
    return collect.with_window_moves(polls).select(
        "ticker", "poll_ts", "window_change_pct", "window_volume")


CHANGES = """SELECT * FROM (SELECT *, lag(sector) OVER w AS ps, lag(industry) OVER w AS pi,
    row_number() OVER w AS rn FROM reference WINDOW w AS (PARTITION BY ticker ORDER BY seen_at, o_orderkey))
    WHERE rn=1 OR sector IS DISTINCT FROM ps OR industry IS DISTINCT FROM pi"""


@query("e11_change_only", with_("reference", f"""SELECT ticker, {t('seen_at','seen_at')}, o_orderkey, sector,
    industry FROM changes""", changes=CHANGES))
def change_only(spark, d):
    return collect.change_only(
        src.reference(spark, d), ["ticker"], "seen_at", ["sector", "industry"], ["o_orderkey"], "day"
    ).select("ticker", "seen_at", "o_orderkey", "sector", "industry")


K2 = f"""SELECT *, {pct('price','open_price')} AS wc, greatest(volume-open_volume,0) AS wv FROM (
    SELECT *, first_value(price) OVER w AS open_price, first_value(volume) OVER w AS open_volume
    FROM (SELECT *, date_trunc('day', poll_ts) + to_hours((hour(poll_ts)//4)*4) AS window_start
      FROM labelled WHERE rule NOT IN ('below_price_floor','no_rule_matched'))
    WINDOW w AS (PARTITION BY ticker, window_start ORDER BY poll_ts))"""


def _collected(spark, d):
    return collect.collect_polls(src.polls(spark, d), COLLECT, IntegrityRules(),
                                 four_hours(F.col("poll_ts")))


HALT_MINUTES = 4 * src.BAR_MINUTES
K2_KNOWN = f"""SELECT k.*, coalesce({pct('price','prev_close')}, change_pct) AS gap, rv,
    (epoch_us(poll_ts) - epoch_us(ended)) / 60000000.0::DOUBLE >= {HALT_MINUTES} AS silent,
    CASE WHEN b.high > 1e-9 AND b.low > 1e-9 THEN (b.high-b.low)/((b.high+b.low)/2)*100 END AS spread,
    coalesce(CASE WHEN prev_close > 1e-9 THEN abs(price/prev_close-1) > 0.8::DOUBLE AND rv < 2
      AND NOT EXISTS (SELECT 1 FROM user_actions a WHERE a.ticker=k.ticker AND a.effective_date=k.date) END,
      false) AS suspect
    FROM (SELECT k2.*, y.prev_close, volume/(average_volume_10d*0.05::DOUBLE) AS rv FROM k2
      LEFT JOIN udaily y ON y.ticker=k2.ticker AND y.date=k2.date) k
    ASOF LEFT JOIN (SELECT *, minute + INTERVAL {src.BAR_MINUTES} MINUTE AS ended FROM ubars) b
      ON b.ticker=k.ticker AND b.date=k.date AND b.ended <= k.poll_ts"""


def collected_with_facts(spark, d):
    """Collection that knows the bars, closes and actions of its days."""
    return collect.collect_polls(
        src.polls(spark, d), COLLECT, IntegrityRules(halt_min_silent_minutes=HALT_MINUTES),
        four_hours(F.col("poll_ts")), src.user_daily(spark, d), bars=src.user_bars(spark, d),
        actions=src.user_actions(spark, d), bar_minutes=src.BAR_MINUTES)


@query("k2_collected_snapshots", with_("polls ubars udaily user_actions", f"""SELECT ticker, {t('date','date')},
    {t('poll_ts','poll_ts_utc')}, {r('price','price')}, {r('volume','session_volume')},
    {r('gap','gap_pct')}, {r('wc','window_change_pct')}, {r('wv','window_volume')},
    {r('rv','rvol')}, 'fallback' AS rvol_source,
    {r('price*volume','dollar_volume')}, {r('NULL','bid')}, {r('NULL','ask')}, {r('spread','spread_pct')},
    CASE WHEN spread IS NULL THEN 'unavailable' ELSE 'estimated' END AS spread_source,
    CASE WHEN silent IS NULL THEN 'unknown' WHEN silent THEN 'halted' ELSE 'trading' END AS halt_status,
    silent AS inferred_halt, suspect AS suspect_price, {t('poll_ts','written_at_utc')} FROM known""",
    labelled=LABELLED, k2=K2, known=K2_KNOWN))
def collected_snapshots(spark, d):
    """With what was known at each poll: halt state, spread of the last ended bar, suspect prices."""
    return collected_with_facts(spark, d).snapshots


@query("k2_collected_reference", with_("polls", f"""SELECT ticker, {t('date','date')},
    {t('poll_ts','asof_ts_utc')}, float_shares AS float_shares_outstanding, confidence AS float_confidence,
    {r('average_volume_10d','average_volume_10d_calc')} FROM (SELECT *, lag(confidence) OVER w AS pc,
      row_number() OVER w AS rn FROM (SELECT *, CASE WHEN float_shares IS NULL OR volume/float_shares > 10
      THEN 'low' ELSE 'medium' END AS confidence FROM k2) WINDOW w AS (PARTITION BY ticker, date ORDER BY poll_ts))
    WHERE rn=1 OR pc IS DISTINCT FROM confidence""", labelled=LABELLED, k2=K2))
def collected_reference(spark, d):
    return _collected(spark, d).reference.select(
        "ticker", "date", "asof_ts_utc", "float_shares_outstanding", "float_confidence",
        "average_volume_10d_calc")


@query("g7_collected_tickers", with_("polls", f"""SELECT DISTINCT {t('date','date')}, ticker FROM labelled
    WHERE rule NOT IN ('below_price_floor','no_rule_matched')""", labelled=LABELLED))
def collected_tickers(spark, d):
    return _collected(spark, d).snapshots.select("date", "ticker").distinct()


# --- what-ifs --------------------------------------------------------------

VARIANTS = {
    "float < 30M": whatif.looser(float_shares_max=30_000_000),
    "gap >= 5": whatif.looser(gap_pct_min=5.0),
    "rvol >= 3": whatif.looser(rvol_min=3.0),
    "no news needed": whatif.looser(require_news=False),
    "price <= 30": whatif.looser(price_max=30.0),
}


def _hit(gap=10, rvol=5, high=20, shares=20000000, news=True):
    tail = " AND coalesce(news_age BETWEEN 0 AND 15,false)" if news else ""
    return (f"bool_or(coalesce(gap_pct>={gap} AND rvol>={rvol} AND price BETWEEN 2 AND {high} "
            f"AND float_shares<{shares}{tail},false))")


def _whatif_sql(variants):
    days = ", ".join(f"{_hit(**kw)} AS c{i}" for i, kw in enumerate(variants.values()))
    parts = " UNION ALL ".join(f"""SELECT '{label}' AS label, count(*) FILTER (ran AND c{i}) AS runners_caught,
        count(*) FILTER (ran AND NOT c{i}) AS runners_missed,
        count(*) FILTER (ran AND c{i} AND NOT base) AS extra_runners_caught,
        count(*) FILTER (ran AND c{i} AND NOT base) AS extra_alerts_that_ran,
        count(*) FILTER (NOT ran AND c{i} AND NOT base) AS extra_alerts_that_did_not,
        count(*) FILTER (base) AS baseline_alerts, count(*) FILTER (c{i}) AS candidate_alerts FROM days"""
                              for i, label in enumerate(variants))
    return with_("evals", f"""SELECT *, label||': +'||extra_runners_caught||' runners caught, +'||
        extra_alerts_that_did_not||' extra alerts that did not run' AS summary FROM ({parts})""",
                 days=f"""SELECT ticker, date, bool_or(was_runner) AS ran, {_hit()} AS base, {days}
                 FROM evals GROUP BY ticker, date""")


def _records(spark, d):
    return src.evals(spark, d).withColumn(
        "had_news", F.coalesce(F.col("news_age").between(0, 15), F.lit(False)))


@query("d18_whatif_counts", _whatif_sql({"float < 30M": {"shares": 30000000}}))
def whatif_counts(spark, d):
    return whatif.sweep(_records(spark, d), TH, {"float < 30M": VARIANTS["float < 30M"]})


SWEEP = {"float < 30M": {"shares": 30000000}, "gap >= 5": {"gap": 5}, "rvol >= 3": {"rvol": 3},
         "no news needed": {"news": False}, "price <= 30": {"high": 30}}


@query("d19_whatif_sweep", _whatif_sql(SWEEP))
def whatif_sweep(spark, d):
    return whatif.sweep(_records(spark, d), TH, VARIANTS)


@query("h22_whatif_summary", with_("evals", "SELECT summary FROM (" + _whatif_sql(SWEEP) + ")"))
def whatif_summary(spark, d):
    return whatif.sweep(_records(spark, d), TH, VARIANTS).select("summary")


@query("j1_custom_variation", _whatif_sql({"both": {"shares": 30000000, "gap": 5}}))
def custom_variation(spark, d):
    """Variations are plain callables on the threshold set, so they compose."""
    both = lambda base: VARIANTS["gap >= 5"](VARIANTS["float < 30M"](base))
    return whatif.sweep(_records(spark, d), TH, {"both": both})
