"""Registration, presentation and the SQL prelude shared by the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(col: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, as SQL engines round doubles.

    ``round`` goes by the shortest decimal text: 0.0640625 is a tie there, but
    0.0640625 * 1e6 is below 64062.5.
    """
    size = F.abs(col) * 10.0**digits
    # from 2^52 on doubles are whole
    whole = F.when(size < 2.0**52, F.floor(size) + F.floor((size - F.floor(size)) * 2)).otherwise(size)
    value = whole / 10.0**digits
    return F.when(value == float("inf"), col).when(col < 0, -value).otherwise(value)


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral columns: text for times, long for integers, 6 decimals."""
    out = []
    for field in df.schema:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = rounded(col.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType):
            col = F.concat_ws("|", F.transform(col, lambda x: x.cast("string")))
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin over the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return present(fn(spark, sf_dir))

        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r(expr: str, name: str | None = None) -> str:
    """A double rounded the way :func:`present` rounds it."""
    text = f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE"
    return f"{text} AS {name}" if name else text


def t(expr: str, name: str) -> str:
    """A date or instant as text."""
    return f"({expr})::VARCHAR AS {name}"


def et(expr: str) -> str:
    return f"timezone('America/New_York', timezone('UTC', {expr}))"


def et_instant(day: str, wall: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', ({day})::DATE + TIME '{wall}:00'))"


def sod(expr: str) -> str:
    e = et(expr)
    return f"(hour({e})*3600 + minute({e})*60 + second({e}))"


def mins(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0::DOUBLE)"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 1e-9 THEN (({a})/({b}) - 1.0::DOUBLE)*100.0::DOUBLE END)"


def half_even(expr: str, digits: int) -> str:
    """Fixed decimals with ties to even, as text."""
    return f"printf('%.{digits}f', round_even({expr}, {digits}))"


SESSION = lambda ts: (
    f"CASE WHEN {sod(ts)} >= 14400 AND {sod(ts)} < 34200 THEN 'pre' "
    f"WHEN {sod(ts)} >= 34200 AND {sod(ts)} < 57600 THEN 'regular' "
    f"WHEN {sod(ts)} >= 57600 AND {sod(ts)} < 72000 THEN 'post' END"
)

#: name -> (dependencies, SQL body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), f"""SELECT event_id, user_id, event_type AS ticker, 'U'||user_id AS uticker,
        value+1 AS price, ((props->>'$.k')::BIGINT+1)::DOUBLE AS volume, ts,
        {et('ts')}::DATE AS date FROM events"""),
    "bars": (("ticks",), """SELECT ticker, date, time_bucket(INTERVAL 15 MINUTE, ts) AS minute,
        arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, ts) AS close, sum(volume) AS volume,
        sum(price*volume)/sum(volume) AS vwap, count(*) AS trade_count
        FROM ticks GROUP BY ALL"""),
    "sessions": (("bars",), f"""SELECT ticker, date, session, arg_min(open, minute) AS open,
        max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, sum(volume) AS volume,
        sum(vwap*volume)/sum(volume) AS vwap, count(*) AS bar_count
        FROM (SELECT *, {SESSION('minute')} AS session FROM bars)
        WHERE session IS NOT NULL GROUP BY ALL"""),
    "daily": (("sessions",), """SELECT ticker, date, open, high, low, close, volume,
        lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close
        FROM sessions WHERE session = 'regular'"""),
    "paths": (("bars",), f"""SELECT *, {pct('high','low_so_far')} AS runup_pct,
        {pct('low','high_so_far')} AS drawdown_pct FROM (SELECT *,
        min(low) OVER w AS low_so_far, max(high) OVER w AS high_so_far FROM bars
        WINDOW w AS (PARTITION BY ticker, date ORDER BY minute
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    "shapes": (("paths",), """SELECT ticker, date, max(high) AS day_high, min(low) AS day_low,
        arg_max(close, minute) AS session_close, max(runup_pct) AS max_runup_pct,
        min(drawdown_pct) AS max_drawdown_pct, sum(close*volume) AS dollar_volume,
        count(*) AS bar_count FROM paths GROUP BY ALL"""),
    "moves": (("shapes", "daily", "bars"), f"""SELECT s.*, d.prev_close,
        {pct('day_high','prev_close')} AS up_move_pct,
        {pct('day_low','prev_close')} AS down_move_pct,
        CASE WHEN prev_close > 1e-9 THEN (day_high-day_low)/prev_close*100 END AS range_pct,
        {pct('session_close','day_high')} AS fade_pct,
        (SELECT min(b.minute) FROM bars b WHERE b.ticker=s.ticker AND b.date=s.date
           AND b.high = s.day_high) AS high_minute
        FROM shapes s LEFT JOIN daily d ON d.ticker=s.ticker AND d.date=s.date"""),
    "polls": (("ticks",), """SELECT p.uticker AS ticker, user_id, poll_ts, date, price, volume,
        (price/mean_price-1)*100 AS change_pct, average_volume_10d,
        CASE WHEN user_id % 10 <> 0 THEN (user_id % 30 + 1)*1000000 END::BIGINT AS float_shares
        FROM (SELECT *, sum(hour_volume) OVER (PARTITION BY uticker, date ORDER BY poll_ts) AS volume
              FROM (SELECT date_trunc('hour', ts) AS poll_ts, uticker, arg_max(price, ts) AS price,
                    arg_max(user_id, ts) AS user_id, arg_max(date, ts) AS date,
                    sum(volume) AS hour_volume FROM ticks GROUP BY 1, 2)) p
        JOIN (SELECT uticker, avg(price) AS mean_price, 30*avg(volume) AS average_volume_10d
              FROM ticks GROUP BY 1) m ON m.uticker = p.uticker"""),
    "evals": ((), """SELECT 'P'||l_partkey AS ticker, l_shipdate::DATE AS date,
        l_shipdate + to_minutes(l_linenumber) AS poll_ts, l_shipdate AS window_start,
        l_discount*300 AS gap_pct, l_quantity/5 AS rvol, l_extendedprice/l_quantity/100 AS price,
        CASE WHEN p_size%10<>0 THEN p_size::BIGINT*1000000 END AS float_shares,
        CASE WHEN l_linenumber=7 THEN 'low' ELSE 'medium' END AS confidence,
        CASE WHEN l_returnflag<>'N' THEN l_tax*300 END AS news_age,
        o_orderpriority='1-URGENT' AS was_runner, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_quantity, p_brand AS brand
        FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey"""),
    "statuses": (("evals",), """SELECT *,
        CASE WHEN gap_pct IS NULL THEN 'unknown' WHEN gap_pct>=10 THEN 'pass' ELSE 'fail' END AS p1,
        CASE WHEN rvol IS NULL THEN 'unknown' WHEN rvol>=5 THEN 'pass' ELSE 'fail' END AS p2,
        CASE WHEN news_age IS NOT NULL AND news_age BETWEEN 0 AND 15 THEN 'pass' ELSE 'fail' END AS p3,
        CASE WHEN price IS NULL THEN 'unknown' WHEN price BETWEEN 2 AND 20 THEN 'pass' ELSE 'fail' END AS p4,
        CASE WHEN confidence='low' OR float_shares IS NULL THEN 'unknown'
             WHEN float_shares<20000000 THEN 'pass' ELSE 'fail' END AS p5 FROM evals"""),
    "scored": (("statuses",), """SELECT *,
        (p1='pass')::INT+(p2='pass')::INT+(p3='pass')::INT+(p4='pass')::INT+(p5='pass')::INT AS passed,
        (p1='unknown')::INT+(p2='unknown')::INT+(p3='unknown')::INT+(p4='unknown')::INT
          +(p5='unknown')::INT AS unknown,
        CASE WHEN p1='pass' AND p2='pass' AND p3='pass' AND p4='pass' AND p5='pass' THEN 'A'
             WHEN p1='pass' AND p2='pass' AND p4='pass' AND p5='pass' THEN 'B'
             WHEN p1='pass' AND (p2='pass')::INT+(p3='pass')::INT+(p4='pass')::INT+(p5='pass')::INT>=2
             THEN 'watch' ELSE 'none' END AS tier FROM statuses"""),
    "reference": ((), """SELECT 'C'||o_custkey AS ticker, o_orderdate::DATE AS date,
        o_orderdate AS seen_at, o_orderpriority AS sector, o_orderstatus AS industry,
        o_totalprice AS market_cap, o_orderkey FROM orders"""),
    "news": (("ticks",), """SELECT event_id::VARCHAR AS news_id,
        [uticker, 'U'||((user_id*7)%150)] AS symbols, 'headline '||event_id AS headline,
        ts AS created_at, ts + to_seconds(volume-1) AS received_at, event_id
        FROM ticks WHERE ticker='signup'"""),
    "tagged": (("news",), """SELECT DISTINCT unnest(symbols) AS ticker, news_id, headline,
        created_at, received_at, event_id FROM news"""),
    "purchases": (("ticks",), """SELECT event_id, uticker AS ticker, ts, date FROM ticks
        WHERE ticker='purchase'"""),
    "actions": ((), """SELECT 'P'||p_partkey AS ticker,
        DATE '1998-01-01' + (p_partkey%700)::INT AS effective_date,
        CASE p_size WHEN 1 THEN 'reverse_split' WHEN 2 THEN 'forward_split'
          ELSE 'symbol_change' END AS action_type,
        CASE p_size WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 3.0::DOUBLE END AS ratio,
        CASE WHEN p_size=3 THEN 'P'||p_partkey END AS old_symbol,
        CASE WHEN p_size=3 THEN 'P'||(p_partkey+1) END AS new_symbol
        FROM part WHERE p_size <= 3"""),
    "user_actions": (("actions",), """SELECT 'U'||(substr(ticker, 2)::BIGINT%120) AS ticker,
        DATE '2024-01-01' + (substr(ticker, 2)::BIGINT%30)::INT AS effective_date, action_type, ratio
        FROM actions"""),
    "journal": ((), """SELECT o_orderkey AS entry_id, 'C'||o_custkey AS ticker,
        o_orderdate::DATE AS date, CASE o_orderstatus WHEN 'F' THEN 'traded'
        WHEN 'O' THEN 'skipped' ELSE 'watched' END AS action, o_totalprice/100 AS entry,
        CASE WHEN o_orderkey%2=0 THEN o_totalprice/100*1.02::DOUBLE END AS exit,
        (o_custkey%100)::DOUBLE AS size, o_orderpriority AS tag1, o_orderstatus AS tag2,
        o_orderdate AS created_at FROM orders"""),
    "health": (("ticks",), """SELECT event_id, ts, ts::DATE AS day,
        CASE ticker WHEN 'error' THEN 'down' ELSE 'up' END AS state
        FROM ticks WHERE ticker IN ('error','signup')"""),
    "ubars": (("ticks",), """SELECT uticker AS ticker, date, time_bucket(INTERVAL 15 MINUTE, ts) AS minute,
        arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL"""),
    "udaily": (("ubars",), """SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker
        ORDER BY date) AS prev_close FROM (SELECT ticker, date, arg_max(close, minute) AS close
        FROM ubars GROUP BY ALL)"""),
    "day_evals": (("scored",), """SELECT * EXCLUDE (ticker, date, poll_ts),
        'U'||(l_partkey%120) AS ticker, DATE '2024-01-01' + (l_orderkey%30)::INT AS date,
        (DATE '2024-01-01' + (l_orderkey%30)::INT)::TIMESTAMP + to_minutes(720+l_linenumber) AS poll_ts,
        CASE tier WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS k FROM scored"""),
    "umoves": (("ubars", "udaily"), f"""SELECT a.*, y.prev_close, {pct('day_high','prev_close')} AS up,
        {pct('day_low','prev_close')} AS down FROM (SELECT ticker, date, max(high) AS day_high,
          min(low) AS day_low, arg_max(close, minute) AS last_price, max(run) AS runup,
          sum(close*volume) AS dollars FROM (SELECT *, {pct('high','lo')} AS run FROM (SELECT *,
            min(low) OVER (PARTITION BY ticker, date ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING
            AND CURRENT ROW) AS lo FROM ubars)) GROUP BY ticker, date) a
        JOIN udaily y ON y.ticker=a.ticker AND y.date=a.date"""),
    "snaps": (("polls",), """SELECT *, change_pct AS gap_pct,
        volume/(average_volume_10d*0.05::DOUBLE) AS rvol FROM polls"""),
    "calendar": (("ticks",), """SELECT date, row_number() OVER (ORDER BY date) AS ord
        FROM (SELECT DISTINCT date FROM ticks WHERE dayofweek(date) NOT IN (0, 6))"""),
}


def with_(names: str, body: str, **extra: str) -> str:
    """Prefix ``body`` with the named CTEs and whatever they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
