"""Keyed state of the live system.

Where keys are many (a ticker in a window or on a day), they are dealt by hash over
:data:`GROUPS` groups: Python is called once per group and micro-batch, not once per
key, and works on columns. A group's state lists its keys with what is known of each;
a key is forgotten once the watermark is a given time past its last row. The rows of
a group in one micro-batch number about the batch's rows divided by the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_MS = 3_600_000
#: Groups that many keys are dealt over; a call of Python costs more than a thousand rows in it.
GROUPS = 256
#: How a key travels as one text.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
Step = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _expiring(step: Step, at: str, ttl_ms: int) -> Step:
    """Forget a key ``ttl_ms`` of event time after its last row."""

    def run(key, rows, state):
        if state.hasTimedOut:
            state.remove()
            return
        latest = state.getCurrentWatermarkMs()

        def watched():
            nonlocal latest
            for batch in rows:
                if len(batch):
                    latest = max(latest, batch[at].max().value // 1_000_000)
                yield batch

        yield from step(key, watched(), state)
        state.setTimeoutTimestamp(latest + ttl_ms)

    return run


def _dealt(rows: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Rows with their key as text and the group it falls to."""
    return rows.withColumn("_key", F.to_json(F.struct(*keys), KEY_TEXT)).withColumn(
        "_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


def _keep(held: GroupState, known: dict[str, tuple], latest: dict[str, int], ttl_ms: int) -> None:
    """Store the keys still alive, a list per field, and wake up when the next one ends."""
    passed = held.getCurrentWatermarkMs()
    alive = [key for key in known if latest[key] + ttl_ms >= passed]
    if alive:
        held.update((alive, [latest[key] for key in alive], *map(list, zip(*(known[key] for key in alive)))))
        held.setTimeoutTimestamp(max(min(latest[key] for key in alive) + ttl_ms, passed) + 1)
    elif held.exists:
        held.remove()


def _known(held: GroupState) -> tuple[dict[str, tuple], dict[str, int]]:
    if not held.exists:
        return {}, {}
    keys, latest, *fields = held.get
    return dict(zip(keys, zip(*fields))), dict(zip(keys, latest))


def _seen_last(latest: dict[str, int], batch: pd.DataFrame, at: str, passed: int) -> None:
    """Move the keys of a batch on to their last row."""
    for key, micros in _micros(batch[at]).groupby(batch["_key"]).max().items():
        latest[key] = max(latest.get(key, passed), micros // 1000, passed)


def _number(value) -> float | None:
    return None if pd.isna(value) else float(value)


def first_seen(polls: DataFrame, ttl_ms: int = 24 * HOUR_MS,
               lateness: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """``ticker, window_start, poll_ts, price, volume`` and any further columns, with the window's baseline."""
    columns = [*polls.columns, "open_price", "open_volume", "opened_at"]
    fields = ", ".join(f"{name} {kind}" for name, kind in polls.dtypes)

    def step(_group, rows, held):
        known, latest = _known(held)
        if not held.hasTimedOut:
            batch = pd.concat(list(rows)).sort_values("poll_ts", kind="stable")
            head = batch.drop_duplicates("_key")
            for key, price, volume, opened in zip(
                    head["_key"], head["price"], head["volume"], _micros(head["poll_ts"])):
                if key not in known:
                    known[key] = (_number(price), _number(volume), opened)
            _seen_last(latest, batch, "poll_ts", held.getCurrentWatermarkMs())
            baseline = pd.DataFrame([known[key] for key in batch["_key"]], batch.index,
                                    ["open_price", "open_volume", "opened_at"])
            yield batch.assign(
                open_price=baseline["open_price"].astype("float64"),
                open_volume=baseline["open_volume"].astype("float64"),
                opened_at=pd.to_datetime(baseline["opened_at"], unit="us"))[columns]
        _keep(held, known, latest, ttl_ms)

    on_time = _dealt(polls, ["ticker", "window_start"], groups).withWatermark("poll_ts", lateness)
    return on_time.groupBy("_group").applyInPandasWithState(
        step, fields + ", open_price double, open_volume double, opened_at timestamp",
        "keys array<string>, latest_ms array<bigint>, price array<double>, volume array<double>, opened_us array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)


def change_only(observed: DataFrame, keys: Sequence[str], fields: Sequence[str],
                order: Sequence[str], ttl_ms: int = 48 * HOUR_MS,
                lateness: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Emit a row when it is the first of its key or its fields changed.

    ``order`` starts with the event time.
    NULL equals NULL; what is compared is the last observed row, not the last
    emitted one. Fields are put into one text by Spark, which knows their types:
    a whole number stays one beside a NULL.
    """
    order, columns = list(order), list(observed.columns)
    seen_as = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    def step(_group, rows, held):
        known, latest = _known(held)
        if not held.hasTimedOut:
            batch = pd.concat(list(rows)).sort_values(order)
            before = batch.groupby("_key")["_seen"].shift(1)
            earlier = pd.Series([known.get(key, ("",))[0] for key in batch["_key"]], batch.index)
            changed = batch["_seen"] != before.where(before.notna(), earlier)
            tail = batch.drop_duplicates("_key", keep="last")
            known.update((key, (seen,)) for key, seen in zip(tail["_key"], tail["_seen"]))
            _seen_last(latest, batch, order[0], held.getCurrentWatermarkMs())
            yield batch[changed][columns]
        _keep(held, known, latest, ttl_ms)

    marked = _dealt(observed.withColumn("_seen", seen_as), keys, groups).withWatermark(order[0], lateness)
    return marked.groupBy("_group").applyInPandasWithState(
        step, observed.schema, "keys array<string>, latest_ms array<bigint>, seen array<string>", "append",
        GroupStateTimeout.EventTimeTimeout)


def latest_in_span(events: DataFrame, span_us: int, numeric: bool, groups: int = GROUPS) -> DataFrame:
    """``poll, news_id, news_created_at`` of every poll in ``ticker, span, at, poll, news_id``.

    The state holds the polls not answered yet and the articles of spans that have
    not ended. A timer at the next unanswered poll, then one at the end of the
    next span, which forgets its articles.
    """
    kept = ["_key", "span", "at", "poll", "news_id"]

    def step(_group, rows, held: GroupState):
        parts = []
        if held.exists:
            parts.append(pd.DataFrame(dict(zip(kept, held.get)), columns=kept))
        if not held.hasTimedOut:
            parts += [batch.assign(at=_micros(batch["at"]))[kept] for batch in rows]
        rows = pd.concat(parts, ignore_index=True)
        asked, told = rows[rows["poll"].notna()], rows[rows["news_id"].notna()]
        passed = held.getCurrentWatermarkMs() * 1000
        ready = asked[asked["at"] < passed].sort_values("at")
        asked = asked[asked["at"] >= passed]
        if len(ready):
            told = told.assign(rank=told["news_id"].map(int) if numeric else told["news_id"]).sort_values(
                ["at", "rank"]).drop(columns="rank")
            answered = pd.merge_asof(
                ready[["_key", "at", "poll"]].astype({"at": "int64"}),
                told[["_key", "at", "news_id"]].astype({"at": "int64"}).assign(news_created_at=told["at"]),
                on="at", by="_key", tolerance=span_us)
            yield pd.DataFrame({
                "poll": answered["poll"],
                "news_id": answered["news_id"].astype(object).where(answered["news_id"].notna(), None),
                "news_created_at": pd.to_datetime(answered["news_created_at"].astype("Int64"), unit="us")})
        told = told[(told["span"] + 1) * span_us >= passed]
        if len(asked) or len(told):
            left = pd.concat([asked, told])
            nulls = left[["poll", "news_id"]].astype(object).where(left[["poll", "news_id"]].notna(), None)
            held.update((left["_key"].tolist(), left["span"].astype("int64").tolist(), left["at"].astype("int64").tolist(),
                         nulls["poll"].tolist(), nulls["news_id"].tolist()))
            due = asked["at"].min() if len(asked) else (told["span"].min() + 1) * span_us
            held.setTimeoutTimestamp(int(max(due, passed) // 1000 + 1))
        elif held.exists:
            held.remove()

    return _dealt(events, ["ticker", "span"], groups).groupBy("_group").applyInPandasWithState(
        step, "poll string, news_id string, news_created_at timestamp",
        "keys array<string>, spans array<bigint>, at_us array<bigint>, polls array<string>, news array<string>",
        "append", GroupStateTimeout.EventTimeTimeout)


def first_tickers(rows: DataFrame, order: Sequence[str], tickers: int) -> DataFrame:
    """Of every window in a task: the first B and the first A row of the ``tickers`` that come first.

    What comes later in the order than that many tickers cannot be pushed; so a
    window with very many rows arrives at its state as few from each task.
    """
    order, columns = list(order), list(rows.columns)

    def fold(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["window_start", *order]).drop_duplicates(["window_start", "ticker", "level"])
        first = held.drop_duplicates(["window_start", "ticker"])
        first = first[first.groupby("window_start", dropna=False).cumcount() < tickers]
        return held.merge(first[["window_start", "ticker"]], on=["window_start", "ticker"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = fold(batch if held is None else pd.concat([held, batch]))
        if held is not None and len(held):
            yield held[columns]

    return rows.mapInPandas(run, rows.schema)


def budgeted_pushes(rows: DataFrame, order: Sequence[str], most: int, ttl_ms: int = 24 * HOUR_MS,
                    lateness: str = "10 minutes") -> DataFrame:
    """The pushed rows of every window, ``most`` at most.

    A ticker is pushed at its first A or B row, and after a B once more at its
    first A. ``level`` is 3 for A, 2 for B, 0 otherwise. The state is what was
    pushed: a ticker and a level for each push, so no more than the budget.
    ``order`` starts with the event time.
    """
    order, columns = list(order), list(rows.columns)

    def step(_key, batches, held):
        tickers, levels, used = held.get if held.exists else ([], [], 0)
        pushed = dict(zip(tickers, levels))
        batch = pd.concat(list(batches)).sort_values(order)
        chosen = []
        for i, (ticker, level) in enumerate(zip(batch["ticker"], batch["level"])):
            if used >= most:
                break
            if level > pushed.get(ticker, 0):
                pushed[ticker] = int(level)
                used += 1
                chosen.append(i)
        held.update((list(pushed), list(pushed.values()), used))
        if chosen:
            yield batch.iloc[chosen][columns]

    # as many tickers may have been pushed already as may be pushed now
    ahead = first_tickers(rows.where("level > 0"), order, 2 * most)
    return ahead.withWatermark(order[0], lateness).groupBy("window_start").applyInPandasWithState(
        _expiring(step, order[0], ttl_ms), rows.schema,
        "tickers array<string>, levels array<int>, used int", "append", GroupStateTimeout.EventTimeTimeout)


def outages(log: DataFrame, keys: Sequence[str], report_after_ms: int,
            lateness: str = "10 minutes") -> DataFrame:
    """``*keys, started, ended`` of every gap in ``*keys, ts, event_id, state`` logs.

    A gap that lasts ``report_after_ms`` of event time is reported with a NULL
    end while it lasts, by a timer and without waiting for an event, and again
    with its end when it is over. Repeated ``down`` events are one gap.
    """
    keys = list(keys)

    def step(key, rows, held):
        started, told = held.get if held.exists else (None, False)
        out = []
        # a batch with rows of the key comes in place of its timer
        if started is not None and not told and held.getCurrentWatermarkMs() > started // 1000 + report_after_ms:
            out.append((*key, started, None))
            told = True
        if not held.hasTimedOut:
            for at, state in pd.concat(list(rows)).sort_values(["ts", "event_id"])[["ts", "state"]].itertuples(index=False):
                at = at.value // 1000
                if state == "down" and started is None:
                    started, told = at, False
                elif state == "up" and started is not None:
                    out.append((*key, started, at))
                    started = None
        if started is None:
            if held.exists:
                held.remove()
        else:
            held.update((started, told))
            if not told:
                due = started // 1000 + report_after_ms
                held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs()) + 1)
        if out:
            found = pd.DataFrame(out, columns=[*keys, "started", "ended"])
            for c in ("started", "ended"):
                found[c] = pd.to_datetime(found[c], unit="us")
            yield found

    types = dict(log.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    return log.withWatermark("ts", lateness).groupBy(*keys).applyInPandasWithState(
        step, f"{fields}, started timestamp, ended timestamp", "started bigint, told boolean", "append",
        GroupStateTimeout.EventTimeTimeout)
