"""Declared schema of every lake table, and which tables may never lose rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

#: The thirteen lake tables. ``!`` marks a required column; every
#: table also carries ``source string!`` and ``schema_version int!``.
_DECLARED = {
    "daily_universe": """ticker string!, date date!, session string!, open double, high double,
        low double, close double, volume double, vwap double, prev_close double,
        float_shares bigint, shares_outstanding bigint, market_cap double, sector string,
        split_flag boolean, split_ratio double, days_since_reverse_split int, halt_count int,
        halt_minutes double, suspect_price boolean, ticker_canonical_id string,
        written_at_utc timestamp!""",
    "snapshots": """ticker string!, date date!, poll_ts_utc timestamp!, price double,
        session_volume double, gap_pct double, window_change_pct double, window_volume double,
        rvol double, rvol_source string, dollar_volume double, bid double, ask double,
        spread_pct double, spread_source string, halt_status string, inferred_halt boolean,
        suspect_price boolean, retention_class string, written_at_utc timestamp!""",
    "reference": """ticker string!, date date!, asof_ts_utc timestamp!, sector string,
        industry string, float_shares_outstanding bigint, total_shares_outstanding bigint,
        average_volume_10d_calc double, average_volume_30d_calc double, market_cap double,
        float_source string, float_asof timestamp, float_confidence string,
        float_turnover double, written_at_utc timestamp!""",
    "pruned_summary": """ticker string!, date date!, poll_count int!, first_poll_ts_utc timestamp,
        last_poll_ts_utc timestamp, session_high double, session_low double, last_price double,
        session_volume double, max_gap_pct double, max_rvol double, up_move_pct double,
        down_move_pct double, best_tier string, drop_reason string!, written_at_utc timestamp!""",
    "evaluations": """ticker string!, date date!, poll_ts_utc timestamp!,
        window_start_utc timestamp!, price double, gap_pct double, window_change_pct double,
        rvol double, rvol_source string, float_shares bigint, float_confidence string,
        news_age_minutes double, news_id string, pillar_1_status string!,
        pillar_2_status string!, pillar_3_status string!, pillar_4_status string!,
        pillar_5_status string!, pillars_passed int!, pillars_unknown int!, tier string!,
        rank_score double, is_recent_runner boolean, pushed boolean, push_reason string,
        written_at_utc timestamp!""",
    "news": """news_id string!, date date!, symbols array<string>!, headline string!,
        news_source string!, url string, created_at_utc timestamp!, updated_at_utc timestamp,
        received_at_utc timestamp!, feed_latency_s double, written_at_utc timestamp!""",
    "bars_1m": """ticker string!, date date!, minute_utc timestamp!, open double, high double,
        low double, close double, volume double, trade_count bigint, vwap double,
        resolution_minutes int!, written_at_utc timestamp!""",
    "outcomes": """ticker string!, date date!, reference_ts_utc timestamp!,
        reference_price double, ret_5m_pct double, ret_15m_pct double, ret_30m_pct double,
        ret_60m_pct double, ret_to_open_pct double, ret_to_1100_pct double,
        ret_to_close_pct double, mfe_pct double, mae_pct double, minutes_to_high double,
        high_of_day_pct double, held_above_vwap_1000 boolean, dollar_volume_in_window double,
        est_spread_pct double, tradeable boolean, spans_halt boolean,
        written_at_utc timestamp!""",
    "runners": """ticker string!, date date!, high_of_day_pct double, move_start_utc timestamp,
        first_news_utc timestamp, news_lag_minutes double, best_tier string,
        best_tier_ts_utc timestamp, price_at_move_start double, float_shares bigint,
        dollar_volume double, miss_reasons array<string>!, miss_detail string,
        qualifying_rule string!, written_at_utc timestamp!""",
    "corporate_actions": """ticker string!, date date!, effective_date date!,
        action_type string!, ratio double, old_symbol string, new_symbol string,
        cash_amount double, written_at_utc timestamp!""",
    "listing_status": """ticker string!, date date!, first_seen date!, last_seen date!,
        status string!, ticker_canonical_id string, written_at_utc timestamp!""",
    "journal": """ticker string!, date date!, alert_id string, action string!, entry double,
        exit double, size double, note string, tags array<string>, created_at_utc timestamp!,
        written_at_utc timestamp!""",
    "data_quality": """date date!, table_name string!, rows_collected bigint!,
        polls_expected int, polls_completed int, missing_field_count bigint, api_errors int,
        ws_disconnect_minutes double, suspect_price_rows int, corporate_actions_applied int,
        rvol_baselines_recomputed int, halt_count int, inferred_halt_count int,
        pillar5_low_confidence_share double, news_latency_median_s double,
        news_latency_p95_s double, tradeable_share double, mover_count int, control_count int,
        dropped_count int, move_threshold_pct double, note string,
        written_at_utc timestamp!""",
}

#: Tables no size pressure justifies losing rows from.
NEVER_PRUNED = frozenset({
    "daily_universe", "evaluations", "outcomes", "runners", "news", "pruned_summary",
    "corporate_actions", "listing_status", "journal", "data_quality",
})

_SAFE_WIDENINGS = {("int", "bigint"), ("smallint", "int"), ("tinyint", "int"),
                   ("float", "double"), ("int", "double")}


class UnknownTable(KeyError):
    """A table the lake does not declare."""


class SchemaDrift(ValueError):
    """Data that does not match a table's declared schema."""


class Protected(PermissionError):
    """A destructive step aimed at a table that must keep everything."""


def _parse(declared: str) -> list[tuple[str, str, bool]]:
    out = []
    for item in f"{declared}, source string!, schema_version int!".split(","):
        name, kind = item.split()
        out.append((name, kind.rstrip("!"), kind.endswith("!")))
    return out


TABLES = {name: _parse(text) for name, text in _DECLARED.items()}


def declared(table: str) -> list[tuple[str, str, bool]]:
    """``(column, type, required)`` of a table."""
    try:
        return TABLES[table]
    except KeyError as exc:
        raise UnknownTable(f"unknown lake table {table!r}; known: {sorted(TABLES)}") from exc


def schema(table: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, T._parse_datatype_string(kind), not required)
        for name, kind, required in declared(table)
    ])


def required_columns(table: str) -> tuple[str, ...]:
    return tuple(name for name, _kind, required in declared(table) if required)


def refuse_protected(table: str) -> None:
    """Stop a destructive step before it starts."""
    declared(table)
    if table in NEVER_PRUNED:
        raise Protected(f"{table} is never pruned")


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in contract order and types, or :class:`SchemaDrift`.

    Unknown columns, absent required ones and wrong types fail here, on the
    driver. A NULL in a required column fails the job that writes it, so the
    check costs no pass of its own.
    """
    spec = declared(table)
    names = {name for name, _kind, _required in spec}
    undeclared = sorted(set(df.columns) - names)
    if undeclared:
        raise SchemaDrift(f"{table}: undeclared columns {undeclared}")
    have = dict(df.dtypes)
    out = []
    for name, kind, required in spec:
        if name not in have:
            if required:
                raise SchemaDrift(f"{table}: required column {name!r} is missing")
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        if have[name] not in (kind, "void") and (have[name], kind) not in _SAFE_WIDENINGS:
            raise SchemaDrift(f"{table}: {name} is {have[name]}, declared {kind}")
        col = F.col(name).cast(kind)
        out.append((_filled(col, table, name) if required else col).alias(name))
    return df.select(*out)


def _filled(col: Column, table: str, name: str) -> Column:
    return F.when(col.isNull(), F.raise_error(
        F.lit(f"{table}: required column '{name}' is missing"))).otherwise(col)


def filled(df: DataFrame, table: str) -> DataFrame:
    """The required columns ``df`` has, checked for NULL as :func:`conform` does, nothing added."""
    return df.withColumns({
        c: _filled(F.col(c), table, c) for c in required_columns(table) if c in df.columns})


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """NULLs per required column present in ``df``, in one aggregate."""
    present = [c for c in required_columns(table) if c in df.columns]
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
