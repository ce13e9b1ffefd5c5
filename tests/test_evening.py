"""Running the evening job twice leaves the same rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tapeloom.config import PillarThresholds
from tapeloom.operators import evaluations as ev
from tapeloom.operators import news as news_ops
from tapeloom.plans import evening
from tapeloom.sources import adapters as src
from tapeloom.sources import feeds, lake
from tapeloom.suite import q_plans, q_rules

DAYS = [date(2023, 12, 31) + timedelta(k) for k in range(32)]


def test_rerun_replaces(spark, sf, tmp_path):
    root = str(tmp_path)
    now = F.lit("2024-02-01").cast("timestamp")
    lake.append(feeds.bar_rows(src.user_bars(spark, sf), now, 15), root, "bars_1m", "u")
    summaries = ev.evaluation_summary(src.day_evals(spark, sf), PillarThresholds(), q_rules.EVAL_ORDER)
    firsts = news_ops.first_news(news_ops.by_symbol(src.news(spark, sf)))
    counts = []
    for _again in range(2):
        evening.run_evening(spark, root, DAYS, src.user_daily(spark, sf), src.actions(spark, sf), summaries,
                            firsts, q_plans._standard(q_plans.EVENING), now)
        counts.append([lake.read_table(spark, root, t).count()
                       for t in ("daily_universe", "outcomes", "runners")])
    assert counts[0] == counts[1] and min(counts[0]) > 0


def test_rerun_without_runners_empties_the_day(spark, sf, tmp_path):
    from dataclasses import replace

    root = str(tmp_path)
    now = F.lit("2024-02-01").cast("timestamp")
    lake.append(feeds.bar_rows(src.user_bars(spark, sf), now, 15), root, "bars_1m", "u")
    summaries = ev.evaluation_summary(src.day_evals(spark, sf), PillarThresholds(), q_rules.EVAL_ORDER)
    firsts = news_ops.first_news(news_ops.by_symbol(src.news(spark, sf)))
    found = q_plans._standard(q_plans.EVENING)
    none = replace(found, runners=replace(found.runners, min_dollar_volume=1e18))

    def run(days, rules):
        evening.run_evening(spark, root, days, src.user_daily(spark, sf), src.actions(spark, sf), summaries,
                            firsts, rules, now)
        return {r["date"]: r["rows"] for r in lake.row_counts(spark, root, "runners").collect()}

    days = [date(2024, 1, k) for k in range(8, 13)]
    before = run(days, found)
    busy = sorted(before)[0]
    assert run([busy], none) == {d: n for d, n in before.items() if d != busy}
