"""Boundaries of the rules and text, on literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeloom.config import IntegrityRules, PillarThresholds, RetentionRules, TradabilityRules
from tapeloom.functions import metrics as m
from tapeloom.functions import rules, text
from tapeloom.functions import timegrid as tg
from tapeloom.operators import quality, scan

TH = PillarThresholds()


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def num(x):
    return F.lit(x).cast("double")


def ts(x):
    return F.lit(x).cast("timestamp")


def test_gap_is_inclusive_and_missing_is_unknown(spark):
    assert value(spark, rules.up_on_day(num(10.0), TH), rules.up_on_day(num(9.99), TH),
                 rules.up_on_day(num(None), TH)) == ("pass", "fail", "unknown")


def test_price_band_includes_both_ends(spark):
    assert value(spark, *[rules.price_range(num(x), TH) for x in (2.0, 20.0, 1.99, 20.01, None)]) \
        == ("pass", "pass", "fail", "fail", "unknown")


def test_float_is_strict_and_distrust_wins(spark):
    ok = F.lit("medium")
    assert value(spark, rules.small_float(F.lit(19_999_999), ok, TH),
                 rules.small_float(F.lit(20_000_000), ok, TH),
                 rules.small_float(F.lit(1), F.lit("low"), TH),
                 rules.small_float(F.lit(None).cast("long"), ok, TH)) \
        == ("pass", "fail", "unknown", "unknown")


def test_no_news_fails_and_future_news_fails(spark):
    assert value(spark, *[rules.news_catalyst(num(x), TH) for x in (None, 0.0, 15.0, 15.1, -0.1)]) \
        == ("fail", "pass", "pass", "fail", "fail")


def test_near_miss(spark):
    fail = F.lit("fail")
    assert value(spark, rules.near_miss(fail, num(23e6), num(20e6), 0.2),
                 rules.near_miss(fail, num(80e6), num(20e6), 0.2),
                 rules.near_miss(F.lit("pass"), num(21e6), num(20e6), 0.2),
                 rules.near_miss(fail, num(1.0), num(0.0), 0.2),
                 rules.near_miss(fail, num(None), num(20e6), 0.2)) \
        == (True, False, False, False, False)


def test_tiers(spark):
    def tier(text_, recent=False):
        names = {"p": "pass", "f": "fail", "u": "unknown"}
        return rules.tier([F.lit(names[c]) for c in text_], F.lit(recent))

    assert value(spark, tier("ppppp"), tier("ppfpp"), tier("ppuff", True), tier("ppffp"),
                 tier("pffff"), tier("fpppp"), tier("ppupp")) \
        == ("A", "B", "watch", "watch", "none", "none", "B")


def test_freshness_edges(spark):
    at = ts("2024-01-10 13:00:00")
    assert value(spark, rules.freshness(ts("2024-01-10 12:45:00"), at, 15),
                 rules.freshness(ts("2024-01-10 12:44:54"), at, 15),
                 rules.freshness(ts("2024-01-09 21:00:00"), at, 15),
                 rules.freshness(ts("2024-01-09 20:59:59"), at, 15),
                 rules.freshness(ts("2024-01-10 13:00:01"), at, 15),
                 rules.freshness(F.lit(None).cast("timestamp"), at, 15)) \
        == ("fresh", "today", "today", "stale", "stale", "none")


def test_sessions_are_half_open_across_dst(spark):
    assert value(spark, *[tg.session_of(ts(x)) for x in (
        "2024-01-10 14:29:59", "2024-01-10 14:30:00", "2024-07-10 13:30:00",
        "2024-01-10 21:00:00", "2024-01-11 01:00:00")]) \
        == ("pre", "regular", "regular", "post", None)


def test_wall_time_to_instant_and_back(spark):
    day = F.lit("2026-03-10").cast("date")
    assert str(value(spark, tg.et_instant(day, "08:05"))) == "2026-03-10 12:05:00"
    assert value(spark, tg.minute_offset(ts("2026-03-10 12:05:00")),
                 tg.minute_offset(ts("2026-11-10 13:05:00"))) == (245, 245)


def test_missing_is_not_zero(spark):
    assert value(spark, m.pct_change(num(5.0), num(0.0)), m.pct_change(num(5.0), num(None)),
                 m.guarded_ratio(num(5.0), num(0.0)), m.window_volume(num(5.0), num(None))) \
        == (None, None, None, None)
    assert value(spark, m.window_volume(num(5.0), num(9.0))) == 0.0


def test_rank_score_renormalises(spark):
    from tapeloom.config import RankWeights
    w = RankWeights()
    assert value(spark, m.rank_score(num(None), num(1.0), num(0.0), w)) == pytest.approx(0.6)
    assert value(spark, m.rank_score(num(None), num(None), num(None), w)) is None


def test_float_confidence(spark):
    now, old, new = ts("2024-06-01"), ts("2024-01-01"), ts("2024-05-01")
    none = F.lit(None).cast("timestamp")
    rule = IntegrityRules()

    def conf(shares, turnover, asof):
        return m.float_confidence(F.lit(shares).cast("long"), num(turnover), asof, now,
                                  rule.float_turnover_low_confidence, rule.float_asof_max_age_days)

    assert value(spark, conf(None, 1.0, new), conf(10, 10.1, new), conf(10, 1.0, none),
                 conf(10, 1.0, old), conf(10, 10.0, new)) == ("low", "low", "medium", "low", "high")


def test_tradability_edges(spark):
    rule = TradabilityRules()

    def verdict(dollars, spread):
        ok, _s, source, _r = rules.tradability(num(dollars), num(spread), rule)
        return F.concat(ok.cast("string"), F.lit(" "), source)

    assert value(spark, verdict(50_000.0, 2.0), verdict(49_999.0, 1.0), verdict(60_000.0, 2.1),
                 verdict(None, None), verdict(60_000.0, None)) \
        == ("true estimated", "false estimated", "false estimated", "false unavailable",
            "false estimated")


def test_text(spark):
    assert value(spark, text.fixed(num(12.5), 0), text.fixed(num(-0.001), 2),
                 text.compact(num(23e6)), text.compact(num(None)), text.number(num(1500.0)),
                 text.percent(num(-0.04)), text.percent(num(3.25))) \
        == ("12", "-0.00", "23.0M", "?", "1.5k", "-0.0%", "+3.2%")


def test_decimals_tie_where_the_scaled_double_does(spark):
    # 9.495 * 100 is below 949.5, 1.5 and 2.5 are ties, 1e308 * 100 overflows
    assert value(spark, text.fixed(num(9.495), 2), text.fixed(num(1.5), 0), text.fixed(num(2.5), 0),
                 text.number(num(-9.495)), F.substring(text.fixed(num(1e308), 2), 1, 2)) \
        == ("9.49", "2", "2", "-9.49", "10")


def test_prices_of_orders_tie_like_their_sql(spark):
    import duckdb
    prices = [-134.985, -141.925, -284.165, -134.925, 0.125, 1234.5, 12_345_000.0, 999.995]
    found = spark.createDataFrame([(x,) for x in prices], "x double").select(
        text.number(F.when(F.abs("x") < 1000, F.col("x"))).alias("n")).collect()
    want = duckdb.execute("SELECT CASE WHEN abs(x) < 1000 THEN printf('%.2f', round_even(x, 2)) ELSE '—' END "
                          "FROM (SELECT unnest(?) AS x)", [prices]).fetchall()
    assert [r["n"] for r in found] == [r[0] for r in want]


def test_zeros_and_non_finite_numbers_read_like_their_sql(spark):
    import duckdb
    numbers = [-0.0, 0.0, -0.004, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = rows.select(text.fixed(F.col("x"), 2), text.signed(F.col("x"), 1)).collect()
    want = duckdb.execute("SELECT printf('%.2f', round_even(x, 2)), printf('%+.1f', round_even(x, 1)) "
                          "FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()
    assert [tuple(r) for r in found] == want


def test_control_sample_matches_sha256(spark):
    import hashlib
    from datetime import date
    for ticker in ("ABCD", "XYZ"):
        digest = hashlib.sha256(f"{ticker}2024-01-15".encode()).hexdigest()
        got = value(spark, rules.control_bucket(F.lit(ticker), F.lit(date(2024, 1, 15))))
        assert got == int(digest[:8], 16) % 100


def test_impossible_parameters_are_refused(spark):
    with pytest.raises(ValueError):
        rules.control_weight(0)
    with pytest.raises(ValueError):
        RetentionRules(control_sample_pct=101)
    with pytest.raises(ValueError):
        tg.floor_minutes(F.col("x"), 7)
    with pytest.raises(ValueError):
        m.rvol_fallback(F.col("x"), F.col("y"), 0.0)
    with pytest.raises(ValueError):
        scan.quantiles(spark.range(1).withColumn("k", F.lit(1)), ["k"], "id", {"p": 0.0})
    from tapeloom.operators import research
    with pytest.raises(ValueError):
        research.holdout_cutoff(spark.range(1).withColumn("date", F.current_date()), 1.0)


def test_share_of_nothing_is_null(spark):
    assert value(spark, quality.share(F.lit(0), F.lit(0))) is None


def test_near_miss_below_a_range(spark):
    from pyspark.sql import functions as F

    from tapeloom.functions.rules import near_miss

    rows = spark.createDataFrame([(1.9,), (1.0,), (23.0,), (25.0,), (None,)], "v double")
    args = F.lit("fail"), F.col("v"), F.lit(20.0), 0.2
    upper = [r[0] for r in rows.select(near_miss(*args)).collect()]
    either = [r[0] for r in rows.select(near_miss(*args, F.lit(2.0))).collect()]
    assert upper == [False, False, True, False, False]
    assert either == [True, False, True, False, False]
