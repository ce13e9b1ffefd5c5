"""Cutting the data at t changes nothing that is said about t."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import bars as bar_ops
from tapeloom.config import CollectionRules, IntegrityRules
from tapeloom.operators import baseline, collect, integrity, news
from tapeloom.operators.scan import asof_join
from tapeloom.sources import adapters as src

CUT = "2024-01-16 15:00:00"


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def cut():
    return F.lit(CUT).cast("timestamp")


def test_asof_join(spark, sf):
    ref = src.reference(spark, sf)
    at = F.lit("1998-01-01").cast("timestamp")
    probes = ref.select("ticker").distinct().withColumn("ts", at)
    full = asof_join(probes, ref, ["ticker"], "ts", "seen_at", ["seen_at", "market_cap"], ["o_orderkey"])
    past = asof_join(probes, ref.where(F.col("seen_at") <= at), ["ticker"], "ts", "seen_at",
                     ["seen_at", "market_cap"], ["o_orderkey"])
    assert same(full, past)


def test_latest_news(spark, sf):
    probes = src.purchases(spark, sf).where(F.col("ts") <= cut())
    tagged = news.by_symbol(src.news(spark, sf))
    full = news.latest_news(probes, tagged, "ts")
    past = news.latest_news(probes, tagged.where(F.col("created_at") <= cut()), "ts")
    assert same(full, past)
    both = news.latest_news(probes, tagged, "ts", received_too=True)
    seen = news.latest_news(probes, tagged.where(
        F.greatest("created_at", "received_at") <= cut()), "ts", received_too=True)
    assert same(both, seen)


def test_moves_as_of(spark, sf):
    bars = src.bars(spark, sf)
    early = bars.where(F.col("minute") <= bar_ops.tg.et_instant(F.col("date"), "11:00"))
    assert same(bar_ops.move_metrics(bars, as_of="11:00"), bar_ops.move_metrics(early))


def test_baseline_excludes_the_day_itself(spark, sf):
    bars, days = src.bars(spark, sf), src.calendar(spark, sf)
    day = F.lit("2024-01-17").cast("date")
    full = baseline.baselines(lambda: bars, days, [480]).where(F.col("date") == day)
    requested = bars.select("ticker").distinct().withColumn("date", day)
    past = baseline.baselines(lambda: bars.where(F.col("date") < day), days, [480], requested).where(
        F.col("date") == day)
    names = [c for c in full.columns]
    known = bars.where(F.col("date") == day).select("ticker").distinct()
    assert same(full.select(*names), past.select(*names).join(known, "ticker", "left_semi").select(*names))


def test_later_splits_compound(spark):
    from tapeloom.operators.integrity import split_ratio

    rows = spark.sql("""SELECT * FROM VALUES (1, 'a', DATE'2024-01-01'), (2, 'a', DATE'2024-01-05'),
        (3, 'a', DATE'2024-01-06'), (4, 'a', DATE'2024-03-01'), (5, 'b', DATE'2024-01-01'),
        (6, 'c', DATE'2024-01-01'), (7, NULL, DATE'2024-01-01'), (1, 'a', DATE'2024-01-01') AS t(id, ticker, date)""")
    splits = spark.sql("""SELECT * FROM VALUES ('a', DATE'2024-01-05', 2.0D), ('a', DATE'2024-02-01', 3.0D),
        ('a', DATE'2024-02-01', 5.0D), ('a', DATE'2024-02-02', CAST(NULL AS DOUBLE)), ('a', DATE'2024-02-03', 0.0D),
        ('c', DATE'2023-12-31', 7.0D), ('d', DATE'2025-01-01', 9.0D) AS t(ticker, effective_date, ratio)""")
    got = sorted((r["id"], r["split_ratio"]) for r in split_ratio(rows, splits).collect())
    assert got == [(1, 30.0), (1, 30.0), (2, 15.0), (3, 15.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0)]
    assert split_ratio(rows.limit(0), splits).isEmpty()
    assert split_ratio(rows, splits.limit(0)).where("split_ratio <> 1").isEmpty()


def test_poll_meets_one_outcome_at_or_after_it(spark):
    from tapeloom.operators.research import polls_with_outcome

    polls = spark.sql("""SELECT id, 'a' AS ticker, DATE'2024-01-01' AS date, CAST(ts AS TIMESTAMP) AS poll_ts
        FROM VALUES (1, '2024-01-01 09:00:00'), (2, '2024-01-01 10:00:00'), (3, '2024-01-01 10:00:01'),
        (4, '2024-01-01 15:00:00'), (5, NULL) AS t(id, ts)""")
    known = spark.sql("""SELECT 'a' AS ticker, DATE'2024-01-01' AS date, CAST(ts AS TIMESTAMP) AS reference_ts_utc, v
        FROM VALUES ('2024-01-01 10:00:00', 1), ('2024-01-01 11:00:00', 2), ('2024-01-01 12:00:00', 3) AS t(ts, v)""")
    other_day = known.selectExpr("ticker", "date_add(date, 1) AS date", "reference_ts_utc", "v + 10 AS v")
    rows = polls_with_outcome(polls, known.union(other_day), ["v"]).collect()
    assert {r["id"]: r["outcome"] and r["outcome"]["v"] for r in rows} == {1: 1, 2: 1, 3: 2, 4: None, 5: None}
    assert len(rows) == 5


def test_absence_counts_sessions_not_days(spark):
    from pyspark.sql import functions as F

    from tapeloom.operators.listings import transitions

    known = spark.sql("""SELECT ticker, DATE'2023-01-01' AS first_seen, last_seen, status,
        CAST(NULL AS STRING) AS ticker_canonical_id FROM VALUES ('a', DATE'2023-12-20', 'active'),
        ('b', DATE'2023-12-22', 'active'), ('c', DATE'2023-12-24', 'active'), ('d', DATE'2023-12-01', 'renamed'),
        ('e', DATE'2023-12-01', 'active'), ('f', CAST(NULL AS DATE), 'active') AS t(ticker, last_seen, status)""")
    today = spark.sql("SELECT * FROM VALUES ('e'), ('new'), ('new') AS t(ticker)")
    day = F.lit("2024-01-03").cast("date")
    dates = spark.sql("SELECT explode(sequence(DATE'2023-11-01', DATE'2024-02-01')) AS date").where("weekday(date) < 5")
    holidays = dates.where("date NOT BETWEEN DATE'2023-12-23' AND DATE'2024-01-01'")
    gone = lambda *rest: {r["ticker"] for r in transitions(known, today, day, 4, *rest).collect()
                          if r["status"] == "delisted"}
    assert gone() == {"a", "b", "c"}
    assert gone(dates) == {"a", "b", "c"}
    assert gone(holidays) == {"a"}
    rows = transitions(known, today, day, 4, holidays)
    assert rows.columns == transitions(known, today, day, 4).columns and rows.count() == 7
    assert rows.where("ticker = 'new' AND first_seen = DATE'2024-01-03'").count() == 1


def clock(text):
    return F.to_timestamp(F.concat(F.lit("2024-01-16 "), F.col(text)))


def test_a_silence_is_known_once_it_has_lasted(spark):
    day = F.lit("2024-01-16").cast("date")
    bars = spark.createDataFrame(
        [("X", "15:00:00", 2.0, 1.0), ("X", "15:01:00", 3.0, 1.0), ("X", "15:10:00", 1.0, 1.0)],
        "ticker string, t string, high double, low double").withColumns(
        {"minute": clock("t"), "date": day})
    polls = spark.createDataFrame(
        [("X", t) for t in ("15:00:30", "15:04:00", "15:05:00", "15:10:30", "15:11:00")] + [("Y", "15:05:00")],
        "ticker string, t string").withColumns({"poll_ts": clock("t"), "date": day})
    got = {(r.ticker, r.t): (r.halt_status, r.inferred_halt, r.bar_spread_pct)
           for r in integrity.state_at(polls, bars, 3).collect()}
    assert got == {
        ("X", "15:00:30"): ("unknown", None, None), ("Y", "15:05:00"): ("unknown", None, None),
        ("X", "15:04:00"): ("trading", False, 100.0), ("X", "15:05:00"): ("halted", True, 100.0),
        ("X", "15:10:30"): ("halted", True, 100.0), ("X", "15:11:00"): ("trading", False, 0.0)}
    apart = integrity.state_at(polls, bars, 3, sessions={"one": ("10:00", "10:05"), "two": ("10:05", "16:00")})
    assert {r.t: r.halt_status for r in apart.where("ticker = 'X'").collect()} == {
        "15:00:30": "unknown", "15:04:00": "trading", "15:05:00": "unknown",
        "15:10:30": "unknown", "15:11:00": "trading"}


def test_snapshots_know_only_the_past(spark, sf):
    def collected(bars):
        polls = src.polls(spark, sf).where(F.col("poll_ts") <= cut())
        done = collect.collect_polls(
            polls, CollectionRules(min_price=5.0), IntegrityRules(halt_min_silent_minutes=60),
            F.date_trunc("day", F.col("poll_ts")), src.user_daily(spark, sf), bars=bars,
            actions=src.user_actions(spark, sf), bar_minutes=15)
        return done.snapshots
    bars = src.user_bars(spark, sf)
    full = collected(bars)
    assert same(full, collected(bars.where(F.col("minute") <= cut())))
    seen = {c: {r[0] for r in full.select(c).distinct().collect()}
            for c in ("halt_status", "spread_source", "suspect_price")}
    assert seen == {"halt_status": {"unknown", "halted", "trading"},
                    "spread_source": {"estimated", "unavailable"}, "suspect_price": {True, False}}


def test_a_quote_comes_before_the_bar(spark):
    quotes = spark.createDataFrame([(9.0, 11.0), (11.0, 9.0), (None, 9.0), (0.0, 9.0)], "bid double, ask double")
    got = [r[0] for r in quotes.select(integrity.quoted_spread(F.col("bid"), F.col("ask"))).collect()]
    assert got == [20.0, None, None, None]


def test_expiry_reads_its_entries_once(spark):
    from tapeloom.operators import calendar as cal

    days = spark.sql("SELECT date_add(DATE'2024-01-01', CAST(id AS INT)) AS date, CAST(id + 1 AS INT) AS ord FROM range(9)")
    entries = spark.sql("SELECT 'X' AS ticker, DATE'2024-01-02' AS run_date")
    found = cal.expiry(entries, days, "run_date", 5)
    assert str(found.first()["expires_on"]) == "2024-01-07"
    assert any("entries-" in f for f in found.inputFiles())


def test_outcomes_do_not_repeat_bars(spark, sf):
    from tapeloom.operators import outcomes as oc
    from tapeloom.sources import adapters as src

    plan = oc.outcomes(src.bars(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # unfolded after the aggregate, nearer the root
