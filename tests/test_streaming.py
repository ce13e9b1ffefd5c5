"""Keyed state over a replayed stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.streaming import feeds, state
from tapeloom.suite import q_streaming
from tapeloom.suite.q_streaming import drained, replay


def test_a_whole_number_beside_a_null_has_not_changed(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01 10:00:00", 5), ("a", "2024-01-10 10:00:00", 5), ("a", "2024-01-10 10:05:00", None)],
        "k string, at string, v long").select("k", F.col("at").cast("timestamp").alias("ts"), "v")
    stream = state.change_only(replay(rows, "ts", "whole"), ["k"], ["v"], ["ts"], ttl_ms=10**12)
    assert [r["v"] for r in drained(stream, "whole").orderBy("ts").collect()] == [5, None]


def stamped(spark, rows, fields, at):
    return spark.createDataFrame(rows, fields).withColumn(at, F.col(at).cast("timestamp"))


def test_latest_news_meets_late_articles_and_lone_polls(spark):
    polls = stamped(spark, [
        ("A", "2024-01-05 10:00:00.123456", 1, None), ("A", "2024-01-12 10:00:00", 2, 2**60 + 1),
        ("A", "2024-01-12 10:30:00", 3, 3), ("B", "2024-01-12 10:00:00", 4, 4), ("A", "2024-01-20 00:00:00", 5, 5)],
        "ticker string, poll_ts string, id long, big long", "poll_ts")
    news = stamped(spark, [
        ("A", 7, "2024-01-12 09:50:00"), ("A", 10, "2024-01-12 09:55:00"), ("A", 9, "2024-01-12 09:55:00"),
        ("A", 11, "2024-01-12 10:00:00.000001"), ("A", 12, "2024-01-19 23:44:59"), ("B", 13, "2024-01-12 09:45:00")],
        "ticker string, news_id long, created_at string", "created_at")
    found = feeds.latest_news(replay(polls, "poll_ts", "p", closing="3 days"),
                              replay(news, "created_at", "n", closing="3 days"), 15)
    got = {r["id"]: (r["big"], r["news_id"], str(r["poll_ts"])) for r in drained(found, "asof").collect()}
    assert got == {
        1: (None, None, "2024-01-05 10:00:00.123456"), 2: (2**60 + 1, 10, "2024-01-12 10:00:00"),
        3: (3, None, "2024-01-12 10:30:00"), 4: (4, 13, "2024-01-12 10:00:00"), 5: (5, None, "2024-01-20 00:00:00")}


def test_an_outage_is_told_while_it_lasts(spark, monkeypatch):
    monkeypatch.setattr(q_streaming, "FILES", 1)  # a batch is one step
    log = stamped(spark, [
        ("f", "2024-01-05 10:00:00", 1, "down"), ("f", "2024-01-05 10:01:00", 2, "down"), ("f", "2024-01-05 10:02:00", 3, "up"),
        ("f", "2024-01-05 11:00:00", 4, "down"), ("g", "2024-01-12 11:00:00", 5, "up"), ("f", "2024-01-20 11:00:00", 6, "up"),
        ("g", "2024-01-20 11:00:00", 7, "down")], "feed string, ts string, event_id long, state string", "ts")
    found = state.outages(replay(log, "ts", "log", closing="1 days"), ["feed"], 30 * 60_000)
    rows = drained(found, "out").collect()
    told = sorted((r["feed"], str(r["started"]), r["ended"] and str(r["ended"])) for r in rows if r["ended"])
    assert told == [("f", "2024-01-05 10:00:00", "2024-01-05 10:02:00"), ("f", "2024-01-05 11:00:00", "2024-01-20 11:00:00")]
    # the long gap was known to be open before its end, the short one was not
    assert sorted((r["feed"], str(r["started"])) for r in rows if not r["ended"]) == [
        ("f", "2024-01-05 11:00:00"), ("g", "2024-01-20 11:00:00")]


def test_pushes_keep_to_the_budget_across_batches(spark):
    rows = [("w", f"2024-01-05 10:{m:02d}:00", t, lv) for m, t, lv in [
        (0, "a", 2), (0, "a", 2), (1, "b", 0), (2, "a", 3), (3, "c", 2)]] + [
        ("w", "2024-01-12 10:00:00", "c", 2), ("w", "2024-01-12 10:01:00", "c", 3), ("w", "2024-01-12 10:02:00", "d", 3)]
    polls = stamped(spark, rows, "window_start string, poll_ts string, ticker string, level int", "poll_ts")
    found = state.budgeted_pushes(replay(polls, "poll_ts", "pushes"), ["poll_ts", "ticker"], 4, ttl_ms=10**12)
    got = [(r["ticker"], r["level"]) for r in drained(found, "pushes").orderBy("poll_ts", "ticker").collect()]
    assert got == [("a", 2), ("a", 3), ("c", 2), ("c", 3)]


def test_many_keys_are_few_calls(spark, monkeypatch):
    """Keys of one group keep their own state, and Python is called per group, not per key."""
    monkeypatch.setattr(q_streaming, "FILES", 2)
    rows = spark.range(3000).select(
        F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")).alias("ticker"),
        F.lit("2024-01-01").cast("timestamp").alias("window_start"),
        F.expr("timestamp'2024-01-05 10:00:00' + make_interval(0, 0, 0, int(id div 1000) * 7)").alias("poll_ts"),
        F.col("id").cast("double").alias("price"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("volume"))
    found = state.first_seen(replay(rows, "poll_ts", "many"), ttl_ms=10**12, groups=3)
    keys = [k for k in found._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in k]
    assert len(keys) == 1 and "_group" in keys[0]
    got = drained(found, "many")
    first = F.substring("ticker", 2, 9).cast("double")
    assert got.count() == 3000
    assert got.where(~(F.col("open_price") == first)
                     | ~F.col("open_volume").eqNullSafe(F.when(first % 3 > 0, first))).count() == 0
    moved = rows.select("ticker", "poll_ts", (F.col("price") % 1000 + F.floor(F.col("price") / 2000)).alias("v"))
    changed = drained(state.change_only(replay(moved, "poll_ts", "moved"), ["ticker"], ["v"], ["poll_ts"],
                                        ttl_ms=10**12, groups=3), "moved")
    assert changed.groupBy("ticker").count().where("count <> 2").count() == 0 and changed.count() == 2000


def test_a_forgotten_key_begins_anew(spark, monkeypatch):
    monkeypatch.setattr(q_streaming, "FILES", 1)
    rows = stamped(spark, [("a", "2024-01-05 10:00:00", 1), ("b", "2024-01-12 10:00:00", 1), ("b", "2024-01-20 10:00:00", 1),
                           ("a", "2024-01-26 10:00:00", 1)], "k string, ts string, v long", "ts")
    # b is still known when its second row comes, a is not
    for ttl, n in ((24 * state.HOUR_MS, 3), (10**12, 2)):
        found = state.change_only(replay(rows, "ts", "ttl"), ["k"], ["v"], ["ts"], ttl_ms=ttl, groups=1)
        assert drained(found, "ttl").count() == n


def test_replayed_steps_are_written_without_an_exchange(spark, tmp_path):
    """Stored rows in enough files become FILES files, none empty; too few rows are dealt out."""
    from tapeloom.suite.q_streaming import FILES, in_files

    spark.range(0, 9000, 1, 3 * FILES).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many")).repartition(3 * FILES)
    spark.range(0, 20, 1, 1).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    for name, df, exchanges in (("a", many, 1), ("b", many.where("id < 0 OR id > 10"), 1), ("c", few, 1)):
        part = in_files(df)
        assert part._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanges
        part.write.parquet(str(tmp_path / name))
        assert len(list((tmp_path / name).glob("*.parquet"))) == FILES
        assert spark.read.parquet(str(tmp_path / name)).count() == df.count()


def test_polls_are_stored_without_structs(spark, monkeypatch):
    """What ranks read again and again holds no verdict structs and no headlines."""
    from tapeloom.plans import window_poll
    from tapeloom.session import written_once
    from tapeloom.suite import QUERIES

    stored = {}
    monkeypatch.setattr(window_poll, "written_once", lambda df, label: stored.update({label: dict(df.dtypes)}) or written_once(df, label))
    rows = QUERIES["k1_window_poll"](spark, "/root/testdata/sf0.001")
    assert {"news_age_minutes", "news_id"} <= set(rows.columns) and rows.count()
    assert len(stored) == 2 and not [k for kinds in stored.values() for k in kinds.values() if "struct" in k]
