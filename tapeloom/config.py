"""Tunable thresholds as frozen value objects, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass

Window = tuple[str, str]


def check_fraction(value: float, name: str, *, upper_open: bool = True) -> float:
    """Refuse a fraction outside (0, 1) or (0, 1]."""
    ok = 0 < value < 1 if upper_open else 0 < value <= 1
    if not ok:
        raise ValueError(f"{name} must be in (0, 1{')' if upper_open else ']'}, got {value}")
    return value


def check_percent(value: int, name: str, *, positive: bool = False) -> int:
    """Refuse a percentage outside [0, 100], or a zero where one divides by it."""
    if not 0 <= value <= 100 or (positive and value <= 0):
        raise ValueError(f"{name} out of range: {value}")
    return value


@dataclass(frozen=True)
class PillarThresholds:
    gap_pct_min: float = 10.0
    rvol_min: float = 5.0
    news_fresh_minutes: int = 15
    price_min: float = 2.0
    price_max: float = 20.0
    float_shares_max: int = 20_000_000
    require_news: bool = True


@dataclass(frozen=True)
class RankWeights:
    window_change: float = 0.5
    rvol: float = 0.3
    gap: float = 0.2


@dataclass(frozen=True)
class PushRules:
    tier_b_enabled: bool = True
    max_pushes: int = 5


@dataclass(frozen=True)
class CollectionRules:
    min_abs_change_pct: float = 3.0
    min_volume_ratio: float = 2.0
    top_dollar_volume_n: int = 100
    min_price: float = 0.50


@dataclass(frozen=True)
class RetentionRules:
    move_threshold_pct: float = 25.0
    control_sample_pct: int = 10
    max_lake_gb: int = 25
    warn_fraction: float = 0.80
    bars_raw_days: int = 90
    bars_thinned_minutes: int = 5
    snapshots_months: int = 18

    def __post_init__(self) -> None:
        check_percent(self.control_sample_pct, "control_sample_pct")
        check_fraction(self.warn_fraction, "warn_fraction", upper_open=False)


@dataclass(frozen=True)
class IntegrityRules:
    suspect_price_change: float = 0.80
    halt_min_silent_minutes: float = 3
    float_turnover_low_confidence: float = 10.0
    float_asof_max_age_days: int = 90


@dataclass(frozen=True)
class TradabilityRules:
    min_dollar_volume: float = 50_000.0
    max_spread_pct: float = 2.0
    window_minutes: int = 5


@dataclass(frozen=True)
class OutcomeRules:
    reference_times: tuple[str, ...] = ("08:05", "08:35", "09:05", "09:30", "16:05", "16:35")
    forward_minutes: tuple[int, ...] = (5, 15, 30, 60)
    tolerance_minutes: int = 2
    excursion_until: str = "11:00"
    session_end: str = "20:00"
    regular_open: str = "09:30"
    vwap_check: str = "10:00"
    max_bar_tickers: int = 300
    session_change_min_pct: float = 10.0


@dataclass(frozen=True)
class RunnerRules:
    high_of_day_pct_min: float = 50.0
    intraday_move_pct_min: float = 30.0
    intraday_lookback_minutes: int = 15
    intraday_window: Window = ("04:00", "11:00")
    postmarket_move_pct_min: float = 30.0
    min_price: float = 1.0
    min_dollar_volume: float = 1_000_000.0
    move_start_trigger_pct: float = 10.0
    near_miss_fraction: float = 0.20
    recent_runner_days: int = 5
    news_fresh_minutes: int = 15


#: Session bounds and alert windows, market wall clock, half-open.
SESSIONS: dict[str, Window] = {
    "pre": ("04:00", "09:30"),
    "regular": ("09:30", "16:00"),
    "post": ("16:00", "20:00"),
}
ALERT_WINDOWS: tuple[Window, ...] = (
    ("08:00", "08:05"),
    ("08:30", "08:35"),
    ("09:00", "09:05"),
    ("16:00", "16:05"),
    ("16:30", "16:35"),
)
MARKET_TZ = "America/New_York"
DISPLAY_TZ = "Europe/Paris"
BASELINE_DAYS = 10
FALLBACK_SESSION_FRACTION = 0.05
BACKFILL_MINUTES = 60
FEED_DELAY_MINUTES = 15
LATENCY_P95_WARN_S = 60.0
HOLDOUT_FRACTION = 0.30
ROW_CAP = 10_000
