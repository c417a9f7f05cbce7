"""Parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: exchange sessions -----------------------------------------
# market: (time zone, open, close, session minutes)
SESSIONS = {
    "kr": ("Asia/Seoul", "09:00", "15:30", 390),
    "us": ("America/New_York", "09:30", "16:00", 390),
}

# --- Fixed values: label codes -----------------------------------------------
NEITHER, PEAK, TROUGH = 0, 1, 2

# --- Fixed values: feature windows -------------------------------------------
RETURN_WINDOWS = (1, 2, 3, 5, 10)
MOMENTUM_WINDOWS = (5, 10)
MA_PERIODS = (5, 10, 20)
RSI_PERIODS = (7, 14)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BAND_PERIOD, BAND_WIDTH = 20, 2
STOCH_PERIOD = 14
INDEX_RETURN_WINDOWS = (1, 3, 5, 10)
INDEX_TOLERANCE = "2 minutes"
FEATURE_PREFIXES = ("pf_", "vf_", "tf_", "tmf_", "mf_")
MIN_BARS_PER_DAY = 10

# --- Fixed values: split months ----------------------------------------------
VAL_MONTHS, TEST_MONTHS = 6, 12
WALK_TRAIN_MONTHS, WALK_TEST_MONTHS = 6, 1

# --- Fixed values: trading rules ---------------------------------------------
TAKE_PROFIT, STOP_LOSS = 0.10, -0.05
FORCE_CLOSE_MINUTES = 120
START_CAPITAL = 10_000_000.0
SLIPPAGE = 0.005
CONTRACT_SIZE = 100
VOLATILITY, RISK_FREE = 0.25, 0.035
MIN_EXPIRY_DAYS = 7

# --- Fixed values: venue order when bars of several venues meet --------------
VENUE_ORDER = ("XNAS.ITCH", "XNYS.PILLAR", "ARCX.PILLAR")


@dataclass(frozen=True)
class LabelVariant:
    prominence: float
    width: int
    distance: int
    shift: int


@dataclass(frozen=True)
class ModelVariant:
    tree_lookback: int
    sequence_lookback: int
    fill: str


# --- Fixed values: labelling and model variants per timeframe ----------------
LABEL_VARIANTS = {
    "1m": {
        "L1": LabelVariant(prominence=0.003, width=3, distance=5, shift=1),
        "L2": LabelVariant(prominence=0.002, width=1, distance=5, shift=1),
        "L3": LabelVariant(prominence=0.002, width=1, distance=5, shift=0),
    },
    "5m": {
        "L1": LabelVariant(prominence=0.004, width=1, distance=3, shift=1),
        "L2": LabelVariant(prominence=0.0025, width=1, distance=2, shift=1),
        "L3": LabelVariant(prominence=0.0025, width=1, distance=2, shift=0),
    },
}
MODEL_VARIANTS = {
    "1m": {
        "M1": ModelVariant(10, 10, "drop"),
        "M2": ModelVariant(10, 10, "0fill"),
        "M3": ModelVariant(5, 5, "0fill"),
        "M4": ModelVariant(0, 10, "0fill"),
    },
    "5m": {
        "M1": ModelVariant(6, 6, "drop"),
        "M2": ModelVariant(6, 6, "0fill"),
        "M3": ModelVariant(3, 3, "0fill"),
        "M4": ModelVariant(0, 6, "0fill"),
    },
}


def _of(table: dict, timeframe: str, key: str):
    if timeframe not in table:
        raise ValueError(f"unknown timeframe {timeframe!r}; known: {sorted(table)}")
    if key not in table[timeframe]:
        raise ValueError(f"unknown variant {key!r}; known: {sorted(table[timeframe])}")
    return table[timeframe][key]


def label_variant(key: str, timeframe: str = "1m") -> LabelVariant:
    return _of(LABEL_VARIANTS, timeframe, key)


def model_variant(key: str, timeframe: str = "1m") -> ModelVariant:
    return _of(MODEL_VARIANTS, timeframe, key)


def session_of(market: str) -> tuple[str, str, str, int]:
    if market not in SESSIONS:
        raise ValueError(f"unknown market {market!r}; known: {sorted(SESSIONS)}")
    return SESSIONS[market]
