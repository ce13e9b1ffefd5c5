"""Counters of quality rows on a few days by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calendar as cal
from tapeloom.operators import quality
from tapeloom.sources import adapters as src

MORNING = (("09:30", "10:40"),)


def hours(spark, early=False):
    days = spark.sql("SELECT explode(array(DATE '2024-01-16', DATE '2024-01-17')) AS date")
    return cal.with_hours(days, early_close=F.lit(early))


def at(spark, *moments):
    return spark.createDataFrame([(x,) for x in moments], "t string").select(
        F.to_timestamp("t").alias("poll_ts"))


def test_slots_of_a_half_day_end_at_its_close(spark):
    windows = (("12:30", "14:00"), ("16:00", "16:05"))
    whole = cal.expected_polls(hours(spark), windows, 30)
    half = cal.expected_polls(hours(spark, early=True), windows, 30)
    assert whole.groupBy("date").count().select("count").distinct().collect() == [(4,)]
    assert [str(r.slot) for r in half.orderBy("slot").collect()] == [
        "2024-01-16 17:30:00", "2024-01-17 17:30:00"]
    with pytest.raises(ValueError):
        cal.expected_polls(hours(spark), windows, 0)


def test_polls_are_missed_late_or_outside(spark):
    polls = at(spark, "2024-01-16 14:29:00", "2024-01-16 14:31:00", "2024-01-16 14:45:00",
               "2024-01-16 15:30:00", "2024-01-16 15:41:00", "2024-01-18 15:00:00", None)
    got = quality.poll_coverage(
        cal.expected_polls(hours(spark), MORNING, 30), polls, MORNING, 30, 0.5)
    assert {str(r.date): tuple(r)[1:] for r in got.collect()} == {
        "2024-01-16": (3, 2, 1, 1, 30.0), "2024-01-17": (3, 0, 3, 0, 90.0)}
    none = quality.poll_coverage(
        cal.expected_polls(hours(spark).limit(0), MORNING, 30), polls, MORNING, 30, 0.5)
    assert none.count() == 0


def test_an_action_is_applied_once_and_only_splits_cost_baselines(spark):
    actions = spark.sql("""SELECT * FROM VALUES ('X', DATE '2024-01-16', 'forward_split', 2.0),
        ('X', DATE '2024-01-16', 'reverse_split', 0.5), ('Y', DATE '2024-01-16', 'symbol_change', NULL),
        ('Z', DATE '2024-01-17', 'symbol_change', NULL) AS t(ticker, effective_date, action_type, ratio)""")
    got = quality.action_counts(actions).orderBy("date").collect()
    assert [tuple(r)[1:] for r in got] == [(3, 1), (1, 0)]


def test_missing_cells_and_failures(spark):
    rows = spark.sql("""SELECT DATE '2024-01-16' AS date, a, b FROM VALUES (1, NULL), (NULL, NULL), (1, 2) AS t(a, b)""")
    assert [r.missing_field_count for r in quality.missing_fields(rows, ("a", "b")).collect()] == [3]
    log = at(spark, "2024-01-17 03:00:00", "2024-01-17 15:00:00").withColumn("code", F.lit(500))
    got = quality.failed_requests(log, F.col("code") >= 500, at="poll_ts").collect()
    assert sorted((str(r.date), r.api_errors) for r in got) == [("2024-01-16", 1), ("2024-01-17", 1)]


def test_every_counter_of_a_table_is_reached(spark, sf):
    from tapeloom.suite import q_nightly
    rows = q_nightly.quality_rows(spark, sf)
    counted = [*quality.COUNTERS, "ws_disconnect_minutes", *quality.MEASURES]
    sums = rows.agg(*[F.sum(c).alias(c) for c in counted]).first()
    assert [c for c in counted if not sums[c]] == []
    assert rows.where("polls_completed > polls_expected").count() == 0
    assert rows.count() == rows.select("date", "table_name").distinct().count()
    assert src.user_actions(spark, sf).count() > 0
