"""The settings of the two horizons, one frozen record each."""

from __future__ import annotations

from dataclasses import dataclass

HOUR = 3600
DAY = 24 * HOUR


@dataclass(frozen=True)
class Cells:
    """A limit as a number of cells of a row."""

    number: int

    def of(self, cells: int) -> float:
        return self.number


@dataclass(frozen=True)
class Share:
    """A limit as a share of the cells of a row; 1.0 allows all."""

    share: float

    def of(self, cells: int) -> float:
        return self.share * cells


@dataclass(frozen=True)
class Horizon:
    """Everything that differs between the hourly and the daily horizon."""

    name: str
    unit: str  # bar width, a date_trunc unit
    step_seconds: int  # bar width in seconds
    steps: int  # forecast steps
    train_span_days: int
    predict_span_days: int
    max_missing_train: Cells  # per timestamp
    max_missing_predict: Cells | Share  # per timestamp
    max_missing_etl: Share  # per timestamp
    top_features: int
    backtest_features: int
    sequence_steps: int
    predict_sequence_steps: int
    var_columns: int
    predict_var_columns: int
    fold_min_train: int
    fold_test: int
    fold_step: int
    reversion: float  # oscillator and RSI reversion speed
    rsi_band: tuple[float, float]
    recent_rows: int  # rows of the recent mean
    min_history: int  # a projection needs more rows than this
    trend_percent: float
    trend_from_current: bool  # from the last actual value, not from the first forecast
    fresh_seconds: int


# Fixed values of the two horizons.
SHORT = Horizon(
    name="short", unit="HOUR", step_seconds=HOUR, steps=168,
    train_span_days=730, predict_span_days=30,
    max_missing_train=Cells(100), max_missing_predict=Share(0.60), max_missing_etl=Share(0.20),
    top_features=20, backtest_features=20, sequence_steps=20, predict_sequence_steps=30, var_columns=20, predict_var_columns=20,
    fold_min_train=300, fold_test=60, fold_step=60,
    reversion=0.05, rsi_band=(30.0, 70.0), recent_rows=24, min_history=24,
    trend_percent=2.0, trend_from_current=False, fresh_seconds=6 * HOUR,
)
LONG = Horizon(
    name="long", unit="DAY", step_seconds=DAY, steps=180,
    train_span_days=5 * 365, predict_span_days=2 * 365,
    max_missing_train=Cells(70), max_missing_predict=Cells(20), max_missing_etl=Share(0.20),
    top_features=40, backtest_features=50, sequence_steps=30, predict_sequence_steps=15, var_columns=20, predict_var_columns=15,
    fold_min_train=730, fold_test=90, fold_step=90,
    reversion=0.1, rsi_band=(20.0, 80.0), recent_rows=30, min_history=10,
    trend_percent=5.0, trend_from_current=True, fresh_seconds=3 * DAY,
)

# Fixed values of the quality checks.
GATE_MAX_MISSING_RATE = 0.10
MIN_ROWS_PER_SYMBOL = 100
PRICE_CEILING = 100000.0
