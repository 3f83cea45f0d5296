"""Settings for a run. Column names live in `Roles` and nowhere else."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------

# (low, high, label): band of the median whole-day gap between timestamps.
FREQUENCY_BANDS = (
    (0, 1, "Daily"),
    (2, 9, "Weekly"),
    (10, 45, "Monthly"),
    (46, 135, "Quarterly"),
    (136, 400, "Yearly"),
)
IRREGULAR = "Irregular"
SUB_MONTHLY = ("Daily", "Weekly")
COARSER_THAN_MONTHLY = ("Quarterly", "Yearly")

# Periods per seasonal cycle of each grain; anything else counts as 12.
SEASON_LENGTH = {"Daily": 7, "Weekly": 52, "Monthly": 12, "Quarterly": 4, "Yearly": 1}
DEFAULT_SEASON_LENGTH = 12

SINGLE_SERIES_ID = "__single_series__"
KEY_SEPARATOR = " | "

LAGS = (1, 2, 3, 12)
ROLLING_WINDOWS = (3, 6)
CALENDAR_FEATURES = ("month", "quarter")
MIN_TRAINING_ROWS = 8

REASONS = {
    "non_finite_forecast": "Non-Finite Forecast Values",
    "excessive_volatility": "Excessive Forecast Volatility",
    "percentile_spike": "Unrealistic Forecast Spikes",
    "iqr_bounds": "Historical Bound Violation",
    "abnormal_growth": "Abnormal Growth Rate",
    "forecast_variance": "High Forecast Variance",
    "flat_forecast": "Flat Or Near-Constant Forecast",
    "excessive_smoothing": "Excessive Smoothing",
    "missing_seasonality": "Missing Seasonality",
    "missing_trend": "Missing Trend",
}

MIN_HORIZON, MAX_HORIZON = 6, 60

# Run stages in order, and the phase each one is shown under.
STAGES = (
    ("Load Dataset", "Load & Prepare"),
    ("Detect Frequency", "Load & Prepare"),
    ("Assess Quality", "Load & Prepare"),
    ("Preprocess Dataset", "Load & Prepare"),
    ("Persist Curated", "Load & Prepare"),
    ("Verify Curated", "Load & Prepare"),
    ("Generate Groups", "Build Series"),
    ("Build Series", "Build Series"),
    ("Train Models", "Train Models"),
    ("Evaluate Models", "Evaluate Models"),
    ("Explain Models", "Explain Models"),
    ("Rank & Select", "Rank & Select"),
    ("Persist Models", "Publish Results"),
    ("Export Forecasts", "Publish Results"),
    ("Business Insights", "Publish Results"),
    ("Mirror Artifacts", "Publish Results"),
    ("MLflow Tracking", "Publish Results"),
)
OLD_STAGE_NAMES = {
    "Assess Data Quality": "Assess Quality",
    "Persist Curated Dataset": "Persist Curated",
    "Verify Curated Dataset": "Verify Curated",
    "Generate Forecast Groups": "Generate Groups",
    "Build Forecast Series": "Build Series",
    "Generate Explainability (SHAP)": "Explain Models",
    "Rank & Select Production Models": "Rank & Select",
    "Persist Winning Models": "Persist Models",
    "Generate Business Insights": "Business Insights",
    "Track to MLflow": "MLflow Tracking",
}


class ConfigurationError(ValueError):
    """The role mapping or a run option is not usable."""


class DataError(ValueError):
    """The data itself cannot be forecast as configured."""


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. Empty `keys` means one single series."""

    date: str
    target: str
    keys: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    method: str = "sum"  # sum | mean | last

    @property
    def mode(self) -> str:
        return "Multi Series" if self.keys else "Single Series"

    @property
    def key_label(self) -> str | None:
        return " + ".join(self.keys) or None

    @property
    def columns(self) -> list[str]:
        return [self.date, self.target, *self.keys, *self.features]

    def check(self, available: list[str] | None = None) -> "Roles":
        if not self.date or not self.target:
            raise ConfigurationError("A date column and a target column are both required.")
        if self.method not in ("sum", "mean", "last"):
            raise ConfigurationError(f"Unknown aggregation method {self.method!r}.")
        twice = sorted({c for c in self.columns if self.columns.count(c) > 1})
        if twice:
            raise ConfigurationError(f"More than one role given to: {', '.join(twice)}.")
        if available is not None:
            absent = [c for c in self.columns if c not in set(available)]
            if absent:
                raise ConfigurationError(f"Not in the dataset: {', '.join(absent)}.")
        return self


@dataclass(frozen=True)
class Cleaning:
    missing: str = "drop"  # none drop forward_fill backward_fill interpolate zero mean median
    drop_duplicates: bool = True
    duplicate_scope: str = "full_row"  # full_row | key_and_date
    convert_date: bool = True
    convert_target: bool = True
    drop_unparsed_dates: bool = True
    min_parse_ratio: float = 0.95
    dayfirst: bool = False
    roll_up: bool = True
    feature_methods: dict = field(default_factory=dict)
    default_feature_method: str = "mean"
    min_rows: int = 12
    min_rows_per_group: int = 24
    drop_thin_groups: bool = False


@dataclass(frozen=True)
class Quality:
    max_missing_ratio: float = 0.10
    min_rows: int = 12
    count_missing_periods: bool = True


@dataclass(frozen=True)
class Backtest:
    strategy: str = "rolling"  # rolling | expanding
    horizon: int = 3
    min_train: int = 12
    step: int | None = None
    max_folds: int | None = 5  # None: all that fit
    window: int | None = None
    newest_first: bool = False


@dataclass(frozen=True)
class Rules:
    max_volatility_ratio: float = 2.5
    lower_percentile: float = 0.01
    upper_percentile: float = 0.99
    percentile_tolerance: float = 0.25
    iqr_multiplier: float = 3.0
    max_growth_ratio: float = 1.5
    growth_periods: int = 12
    max_variance_ratio: float = 3.0
    min_volatility_ratio: float = 0.05
    min_smoothing_ratio: float = 0.15
    season: int = 12
    min_season_strength: float = 0.3
    min_season_range: float = 0.25
    min_trend: float = 0.05
    min_trend_kept: float = 0.1
    min_history: int = 12
    off: frozenset = frozenset()  # rule ids switched off


@dataclass(frozen=True)
class Ranking:
    metric_weights: tuple = (("mape", 0.15), ("wmape", 0.35), ("rmse", 0.2), ("mae", 0.15), ("smape", 0.15))
    variance: float = 0.4
    smoothness: float = 0.35
    interval: float = 0.25
    no_interval: float = 0.5
    backtest: float = 0.5
    stability: float = 0.25
    importance: float = 0.25
    neutral: float = 0.5


@dataclass(frozen=True)
class Importance:
    resamples: int = 3
    segments: int = 2
    min_rows: int = 8
    fractions: tuple = (0.5, 1.0)
    min_correlation: float = 0.05
    max_share_move: float = 0.25
    stability: float = 0.4
    plausibility: float = 0.3
    horizon: float = 0.3
    fallback_score: float = 1.0
    holdout: bool = False  # shuffle on each key's newest rows, under a model fitted without them
    seeds: tuple = (42, 1000, 1001)


@dataclass(frozen=True)
class Search:
    """Budget of a parameter search: settings of a model family, and chronological splits they are judged on."""

    trials: int = 8
    splits: int = 3
    min_rows: int = 48  # of a series that takes part
    seed: int = 42


@dataclass(frozen=True)
class Drift:
    min_rows: int = 20
    min_distinct: int = 8
    min_distinct_ratio: float = 0.15
    shapiro_max_rows: int = 2000
    alpha: float = 0.05
    ks_min_rows: int = 30
    method: str = "auto"  # auto percentile bootstrap kernel_density, or a registered null
    algorithm: str = "auto"  # or a statistic, built in or registered, for every key
    percentile: float = 0.95
    bootstrap_from: int = 24
    kde_from: int = 60
    resamples: int = 200
    kde_draws: int = 2000
    seed: int = 42
    bins: int = 10


@dataclass(frozen=True)
class ModelSpec:
    name: str
    min_rows: int
    takes_features: bool = False
    candidate: bool = True
    searched: bool = False


# Registry order is the tie-break order of every ranking.
MODELS = (
    ModelSpec("trend_seasonal", 24, takes_features=True),
    ModelSpec("autoregressive", 20),
    ModelSpec("boosted_trees", 24, takes_features=True, searched=True),
    ModelSpec("random_forest", 24, takes_features=True, searched=True),
    ModelSpec("seasonal_naive", 2, candidate=False),
)
FALLBACK_MODEL = "seasonal_naive"
EXTRA_MODELS: list[ModelSpec] = []  # see keycast.registry


def resolve_models(selected: list[str] | None = None) -> tuple[ModelSpec, ...]:
    """Candidate specs for a run; unknown names and the fallback are refused."""
    candidates = {m.name: m for m in (*MODELS, *EXTRA_MODELS) if m.candidate}
    if selected is None:
        return tuple(candidates.values())
    unknown = [name for name in selected if name not in candidates]
    if unknown:
        raise ConfigurationError(f"Not a candidate model: {', '.join(unknown)}.")
    return tuple(m for m in candidates.values() if m.name in selected)


def offered_models(skipped: set[str] = frozenset()) -> list[str]:
    """Candidate names minus those a deployment is known to skip."""
    return [m.name for m in (*MODELS, *EXTRA_MODELS) if m.candidate and m.name not in skipped]


def resolve_features(selected: list[str] | None = None) -> dict[str, list]:
    """Chosen derived features split by kind. None means all, [] means none."""
    known = [f"lag_{n}" for n in LAGS] + [f"rolling_mean_{n}" for n in ROLLING_WINDOWS] + list(CALENDAR_FEATURES)
    chosen = set(known if selected is None else selected)
    return {
        "lags": [n for n in LAGS if f"lag_{n}" in chosen],
        "rolling_windows": [n for n in ROLLING_WINDOWS if f"rolling_mean_{n}" in chosen],
        "calendar_features": [c for c in CALENDAR_FEATURES if c in chosen],
        "rejected": sorted(chosen - set(known)),
    }


def check_horizon(horizon: int) -> int:
    if not MIN_HORIZON <= horizon <= MAX_HORIZON:
        raise ConfigurationError(f"Horizon must be between {MIN_HORIZON} and {MAX_HORIZON}; got {horizon}.")
    return horizon


@dataclass(frozen=True)
class RunOptions:
    """Everything a run can be told, with the defaults the engine ships with."""

    cleaning: Cleaning = field(default_factory=Cleaning)
    quality: Quality = field(default_factory=Quality)
    backtest: Backtest = field(default_factory=Backtest)
    rules: Rules = field(default_factory=Rules)
    ranking: Ranking = field(default_factory=Ranking)
    importance: Importance = field(default_factory=Importance)
    drift: Drift = field(default_factory=Drift)
    search: Search | None = field(default_factory=Search)  # None: defaults only
    horizon: int = 12
    models: tuple[str, ...] | None = None
    derived_features: tuple[str, ...] | None = None
