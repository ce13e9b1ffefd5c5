"""Contracts, guards and partition operations."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tapeloom import contracts
from tapeloom.config import RetentionRules
from tapeloom.sources import feeds, lake, landed


def bar_rows(spark, days=("2024-01-02", "2024-01-03"), n=20):
    rows = spark.range(n * len(days)).withColumn(
        "date", F.element_at(F.array(*[F.lit(d).cast("date") for d in days]),
                             (F.col("id") % len(days) + 1).cast("int")))
    return rows.select(
        F.lit("AA").alias("ticker"), "date",
        F.timestamp_seconds(F.unix_date("date").cast("long") * 86400 + F.col("id") * 60)
        .alias("minute_utc"),
        F.col("id").cast("double").alias("close"), F.lit(1.0).alias("volume"),
        F.lit(1).alias("resolution_minutes"), F.current_timestamp().alias("written_at_utc"))


def test_provenance_and_empty_reads(spark, tmp_path):
    root = str(tmp_path)
    assert lake.read_day(spark, root, "bars_1m", date(2024, 1, 2)).count() == 0
    lake.append(bar_rows(spark), root, "bars_1m", "unit")
    got = lake.read_day(spark, root, "bars_1m", date(2024, 1, 2))
    assert got.count() == 20
    assert {(r["source"], r["schema_version"]) for r in got.collect()} == {("unit", 1)}


def test_drift_is_refused(spark, tmp_path):
    rows = bar_rows(spark)
    with pytest.raises(contracts.SchemaDrift):
        lake.append(rows.withColumn("surprise", F.lit(1)), str(tmp_path), "bars_1m", "u")
    with pytest.raises(contracts.SchemaDrift):
        lake.append(rows.drop("ticker"), str(tmp_path), "bars_1m", "u")
    with pytest.raises(contracts.SchemaDrift):
        lake.append(rows.withColumn("close", F.lit("x")), str(tmp_path), "bars_1m", "u")
    with pytest.raises(contracts.UnknownTable):
        lake.append(rows, str(tmp_path), "bars", "u")


def test_null_in_required_column_commits_nothing(spark, tmp_path):
    bad = bar_rows(spark).withColumn("ticker", F.when(F.col("close") != 7, F.col("ticker")))
    with pytest.raises(Exception, match="required column"):
        lake.append(bad, str(tmp_path), "bars_1m", "u")
    assert lake.files(spark, str(tmp_path), "bars_1m").count() == 0


def test_compaction_keeps_rows(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        lake.append(bar_rows(spark).withColumn("volume", F.lit(float(i))), root, "bars_1m", "u")
    before = sorted(map(str, lake.read_table(spark, root, "bars_1m").collect()))
    report = lake.compact(spark, root, "bars_1m").collect()
    assert {(r["files_before"], r["files_after"], r["rows"]) for r in report} == {(3, 1, 60)}
    assert sorted(map(str, lake.read_table(spark, root, "bars_1m").collect())) == before
    assert lake.compact(spark, root, "bars_1m").count() == 0


def test_replacing_a_day_from_itself(spark, tmp_path):
    root = str(tmp_path)
    lake.append(bar_rows(spark), root, "bars_1m", "u")
    for _again in range(2):
        day = lake.read_day(spark, root, "bars_1m", date(2024, 1, 2))
        lake.replace_days(day.withColumn("volume", F.lit(9.0)), root, "bars_1m", "u")
    got = {r["date"]: (r["n"], r["v"]) for r in lake.read_table(spark, root, "bars_1m").groupBy(
        "date").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).collect()}
    assert got == {date(2024, 1, 2): (20, 180.0), date(2024, 1, 3): (20, 20.0)}


def test_rewrite_removes_emptied_days_and_respects_protection(spark, tmp_path):
    root = str(tmp_path)
    lake.append(bar_rows(spark), root, "bars_1m", "u")
    rows = lake.read_table(spark, root, "bars_1m")
    lake.rewrite_days(rows.where("date = '2024-01-03' and close > 30"), root, "bars_1m",
                      [date(2024, 1, 2), date(2024, 1, 3)], "u")
    left = lake.row_counts(spark, root, "bars_1m").collect()
    assert [(r["date"], r["rows"]) for r in left] == [(date(2024, 1, 3), 5)]
    with pytest.raises(contracts.Protected):
        lake.rewrite_days(rows, root, "evaluations", [date(2024, 1, 2)], "u")
    with pytest.raises(contracts.Protected):
        lake.drop_days(spark, root, "runners", F.current_date())


def test_sql_is_read_only_capped_and_guarded(spark, tmp_path):
    root = str(tmp_path)
    lake.append(bar_rows(spark, [f"2024-01-{d:02d}" for d in range(1, 11)], 2), root, "bars_1m", "u")
    assert lake.run_sql(spark, root, "SELECT * FROM bars_1m;", row_cap=3).count() == 3
    seen = lake.run_sql(spark, root, "SELECT max(date) AS d FROM bars_1m", holdout="bars_1m")
    assert seen.first()["d"] == date(2024, 1, 7)
    free = lake.run_sql(spark, root, "SELECT max(date) AS d FROM bars_1m", holdout="bars_1m",
                        allow_holdout=True)
    assert free.first()["d"] == date(2024, 1, 10)
    for text in ("DROP VIEW bars_1m", "CREATE TABLE t (a int)", "INSERT INTO bars_1m SELECT 1"):
        with pytest.raises(Exception):
            lake.run_sql(spark, root, text)


def test_size_warning_threshold(spark):
    sizes = spark.createDataFrame([("a", 19 * 1024**3), ("b", 1024**3)], "table_name string, size_bytes long")
    assert tuple(lake.size_warning(sizes, RetentionRules()).first()) == (20.0, 25.0, 0.8, ["a", "b"])
    assert lake.size_warning(sizes.where("table_name = 'a'"), RetentionRules()).count() == 0


def test_changed_column_contract_is_fatal(spark, sf):
    with pytest.raises(Exception, match="column contract has changed"):
        feeds.scanner_records(landed.scanner_payloads(spark, sf, broken_arity=True)).collect()
    with pytest.raises(feeds.ContractChanged):
        feeds.missing_columns([c for c in feeds.SCANNER_COLUMNS if c != "close"])
    assert feeds.missing_columns(feeds.SCANNER_COLUMNS) == []


def test_nan_and_share_counts(spark):
    row = ["abcd", "d", "NYSE", "stock", '["common"]', "NaN", "1", "2"] + [None] * 3 + ["123.9", "-4"] \
        + [None] * 9
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in feeds.SCANNER_COLUMNS)) \
        .withColumn("poll_ts", F.current_timestamp())
    got = feeds.scanner_rows(df).first()
    assert (got["ticker"], got["close"], got["float_shares"], got["shares_outstanding"]) \
        == ("ABCD", None, 123, None)


def test_capped_sql_tells_truncation(spark, tmp_path):
    root = str(tmp_path)
    lake.append(bar_rows(spark), root, "bars_1m", "u")
    cut = lake.capped(spark, root, "SELECT * FROM bars_1m", 39)
    whole = lake.capped(spark, root, "SELECT * FROM bars_1m", 40)
    assert (cut.rows.count(), cut.truncated, whole.rows.count(), whole.truncated) == (39, True, 40, False)
    lake.to_csv(lake.run_sql(spark, root, "SELECT id FROM range(25000)"), f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 25_000


def test_days_are_set_exactly(spark, tmp_path):
    root, days = str(tmp_path), [date(2024, 1, 2), date(2024, 1, 3)]
    lake.append(bar_rows(spark, ["2024-01-02", "2024-01-03", "2024-01-04"]), root, "bars_1m", "u")
    rows = lake.read_days(spark, root, "bars_1m", days)
    assert "date#" in (plan := rows._jdf.queryExecution().toString()) and "PartitionFilters: [date" in plan
    lake.set_days(rows.where("date = '2024-01-03' AND close < 20"), root, "bars_1m", days, "u")
    left = {r["date"]: r["rows"] for r in lake.row_counts(spark, root, "bars_1m").collect()}
    assert left == {date(2024, 1, 3): 7, date(2024, 1, 4): 20}
    with pytest.raises(Exception, match="a day not asked for"):
        lake.set_days(lake.read_table(spark, root, "bars_1m"), root, "bars_1m", days, "u")


def test_half_done_swap_is_recovered(spark, tmp_path):
    root = str(tmp_path)
    lake.append(bar_rows(spark), root, "bars_1m", "u")
    staging = tmp_path / "_staging" / "bars_1m-lost"
    staging.mkdir(parents=True)
    # the driver died after setting a day aside, and before moving the new one in
    (tmp_path / "bars_1m" / "date=2024-01-02").rename(staging / "date=2024-01-02-replaced")
    (staging / "date=2024-01-03").mkdir()
    assert lake.recover(spark, root, "bars_1m") == ["2024-01-02"]
    assert lake.read_table(spark, root, "bars_1m").count() == 40 and not staging.exists()
    assert lake.recover(spark, root, "bars_1m") == []


def test_nights_leave_other_days_alone(spark, tmp_path):
    from tapeloom.plans import nightly

    root, now = str(tmp_path), F.current_timestamp()
    polls = spark.createDataFrame(
        [(t, d, p) for d in ("2024-01-01", "2024-01-02") for t in ("MV", "CT", "DR") for p in range(3)],
        "ticker string, day string, p int").select(
        "ticker", F.col("day").cast("date").alias("date"),
        (F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.col("p") + 14)).alias("poll_ts_utc"),
        F.lit(5.0).alias("price"), F.lit(1.0).alias("session_volume"), now.alias("written_at_utc"))
    lake.append(polls, root, "snapshots", "u")

    def night(day):
        known = spark.createDataFrame(
            [("MV", day, "mover"), ("CT", day, "control"), ("DR", day, None)],
            "ticker string, date date, retention_class string").withColumns(
            {c: F.lit(1.0) for c in ("up_move_pct", "down_move_pct", "day_high", "day_low", "last_price",
                                     "session_volume", "max_gap_pct", "max_rvol")} | {
                "poll_count": F.lit(3), "first_poll_ts": now, "last_poll_ts": now,
                "best_tier": F.lit("none"), "reason": F.lit("r")})
        nightly.prune_snapshots(spark, root, [day], known, RetentionRules(), now)
        return {(str(r["date"]), r["ticker"]): r["retention_class"] for r in
                lake.read_table(spark, root, "snapshots").select("date", "ticker", "retention_class").distinct().collect()}

    first = night(date(2024, 1, 1))
    assert first == {("2024-01-01", "MV"): "mover", ("2024-01-01", "CT"): "control",
                     **{("2024-01-02", t): None for t in ("MV", "CT", "DR")}}
    second = night(date(2024, 1, 2))
    assert second == {(d, t): k for d in ("2024-01-01", "2024-01-02") for t, k in (("MV", "mover"), ("CT", "control"))}
    assert lake.row_counts(spark, root, "pruned_summary").count() == 2


def test_report_and_summary_of_a_prune_read_one_written_table(spark):
    from tapeloom.operators import retention as rt

    rows = spark.createDataFrame([("MV", 1), ("DR", 1), ("NEW", 1)], "ticker string, price int").withColumn(
        "date", F.lit("2024-01-01").cast("date"))
    known = spark.createDataFrame([("MV", "mover"), ("DR", None)], "ticker string, retention_class string").withColumns(
        {"date": F.lit("2024-01-01").cast("date"), "poll_count": F.lit(1)} | {c: F.lit(None).cast("double") for c in (
            "first_poll_ts", "last_poll_ts", "day_high", "day_low", "last_price", "session_volume", "max_gap_pct",
            "max_rvol", "up_move_pct", "down_move_pct", "best_tier", "reason")})
    done = rt.prune(rows, known, RetentionRules(), store=True)
    assert {r["ticker"]: r["retention_class"] for r in done.snapshots.collect()} == {"MV": "mover", "NEW": "signal"}
    assert [r["ticker"] for r in done.summary.collect()] == ["DR"]
    assert done.report.first()["rows_after"] == 2
    read = [*done.report.inputFiles(), *done.summary.inputFiles()]
    assert read and all("judged-days" in f for f in read)
