"""Reference window and the ten plausibility rules for forward forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast import registry
from keycast.config import DEFAULT_SEASON_LENGTH, REASONS, SEASON_LENGTH, Rules
from keycast.operators.metrics import finite

CYCLES, HORIZONS = 2, 3


def season_length(grain: str | None) -> int:
    return SEASON_LENGTH.get(grain, DEFAULT_SEASON_LENGTH)


def season_length_of(grain: Column) -> Column:
    from keycast.functions.skew import small_map

    return F.coalesce(F.try_element_at(small_map(SEASON_LENGTH), grain), F.lit(DEFAULT_SEASON_LENGTH))


def window_length(n: Column, grain: str | None | Column, horizon, floor: int = 12) -> Column:
    """How many of the newest observations a forecast is compared with."""
    season = season_length_of(grain) if isinstance(grain, Column) else F.lit(season_length(grain))
    ahead = horizon if isinstance(horizon, Column) else F.lit(horizon)
    wanted = F.greatest(season * CYCLES, F.greatest(ahead, F.lit(0)) * HORIZONS, F.lit(floor))
    return F.greatest(F.lit(0), F.least(n, wanted))


def finite_history(series: DataFrame) -> DataFrame:
    """Series rows with a finite value, renumbered by position."""
    kept = series.where(finite(F.col("y")))
    w = Window.partitionBy("group_id")
    return kept.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("t", F.row_number().over(w.orderBy("t")) - 1)


def reference_window(series: DataFrame, grain: str | None, horizon: int) -> DataFrame:
    """The newest rows of each series that form its reference population."""
    history = finite_history(series)
    return history.where(F.col("t") >= F.col("n") - window_length(F.col("n"), grain, horizon))


def history_facts(series: DataFrame, grain: str | None, horizon: int, rules: Rules = Rules()) -> DataFrame:
    """Everything the rules need to know about a key's past: one row per group, one aggregate."""
    rows = finite_history(series)
    w = Window.partitionBy("group_id")
    inside = F.col("t") >= F.col("n") - window_length(F.col("n"), grain, horizon, rules.min_history)
    rows = rows.withColumn("wy", F.when(inside, F.col("y")))
    rows = rows.withColumn("_c", F.col("wy") - F.avg("wy").over(w))
    rows = rows.withColumn("_lag", F.lag("_c", rules.season).over(w.orderBy("t")))
    wy = F.col("wy")
    cycle = F.when(F.col("t") >= F.col("n") - F.least(F.col("n"), F.lit(rules.season)), F.col("wy"))
    recent = F.when(F.col("t") >= F.col("n") - rules.growth_periods, F.col("y"))
    corners = F.array(*[F.lit(p) for p in (rules.lower_percentile, 0.25, 0.75, rules.upper_percentile)])
    return rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(wy).alias("window_n"),
        F.stddev_pop(wy).alias("window_std"),
        F.avg(wy).alias("window_mean"),
        F.percentile(wy, corners).alias("corners"),
        F.avg(recent).alias("recent_mean"),
        (F.max(cycle) - F.min(cycle)).alias("cycle_range"),
        (F.sum(F.col("_c") * F.col("_lag")) / F.nullif(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0))).alias("acf"),
        F.regr_slope("y", F.col("t").cast("double")).alias("slope"),
        F.avg("y").alias("mean"),
    )


def forecast_facts(forecasts: DataFrame, facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (group, model): forecast shape next to the history facts, bounds applied per step."""
    low, q1, q3, high = [F.element_at("corners", i) for i in (1, 2, 3, 4)]
    slack = (high - low) * rules.percentile_tolerance
    reach = (q3 - q1) * rules.iqr_multiplier
    bounded = facts.select(
        "*", (low - slack).alias("spike_low"), (high + slack).alias("spike_high"),
        (q1 - reach).alias("iqr_low"), (q3 + reach).alias("iqr_high"), (q3 - q1).alias("iqr"),
    )
    rows = forecasts.join(bounded, "group_id", "left")
    v = F.col("value")
    outside = lambda a, b: F.count_if(~F.isnan(v) & ((v < F.col(a)) | (v > F.col(b))))
    carried = ["n", "window_n", "window_std", "window_mean", "recent_mean", "cycle_range", "acf", "slope", "mean", "spike_low", "spike_high", "iqr_low", "iqr_high", "iqr"]
    return rows.groupBy("group_id", "model_name").agg(
        *[F.first(c).alias(c) for c in carried],
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~finite(v)).alias("non_finite"),
        F.stddev_pop(v).alias("f_std"),
        F.avg(v).alias("f_mean"),
        (F.max(v) - F.min(v)).alias("f_range"),
        F.regr_slope(v, F.col("step").cast("double")).alias("f_slope"),
        outside("spike_low", "spike_high").alias("spikes"),
        outside("iqr_low", "iqr_high").alias("iqr_breaches"),
    )


def _measures() -> dict[str, Column]:
    c = F.col
    safe = lambda x: F.nullif(x, F.lit(0.0))
    real = lambda x: F.when(~F.isnan(x), x)
    f_cv, h_cv = c("f_std") / safe(F.abs(c("f_mean"))), c("window_std") / safe(F.abs(c("window_mean")))
    h_trend, f_trend = F.abs(c("slope")) / safe(F.abs(c("mean"))), F.abs(c("f_slope")) / safe(F.abs(c("f_mean")))
    return {
        "volatility": real(c("f_std") / safe(c("window_std"))),
        "growth": real(F.abs(c("f_mean") / safe(c("recent_mean")))),
        "variance": real(f_cv / safe(h_cv)),
        "season": real(c("f_range") / safe(c("cycle_range"))),
        "h_trend": real(h_trend),
        "kept": real(f_trend / safe(h_trend)),
    }


def rule_outcomes(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per rule, ten and the registered ones, of every (group, model). A measure that cannot be computed lets the rule pass."""
    out = judged
    for name, measure in _measures().items():
        out = out.withColumn(f"m_{name}", measure)
    c = F.col
    vol, growth, variance = c("m_volatility"), c("m_growth"), c("m_variance")
    seasonal = (c("window_n") >= 2 * rules.season) & (c("acf") >= rules.min_season_strength)
    trending = c("m_h_trend") >= rules.min_trend
    fails = {
        "non_finite_forecast": (c("non_finite") > 0, c("non_finite").cast("double")),
        "excessive_volatility": (vol > rules.max_volatility_ratio, vol),
        "percentile_spike": (c("spikes") > 0, c("spikes").cast("double")),
        "iqr_bounds": ((c("iqr") != 0) & (c("iqr_breaches") > 0), F.when(c("iqr") != 0, c("iqr_breaches").cast("double"))),
        "abnormal_growth": ((growth > rules.max_growth_ratio) | (growth < 1.0 / rules.max_growth_ratio), growth),
        "forecast_variance": (variance > rules.max_variance_ratio, variance),
        "flat_forecast": (vol < rules.min_volatility_ratio, vol),
        "excessive_smoothing": (vol < rules.min_smoothing_ratio, vol),
        "missing_seasonality": (seasonal & (c("m_season") < rules.min_season_range), F.when(seasonal, c("m_season"))),
        "missing_trend": (trending & (c("m_kept") < rules.min_trend_kept), F.when(trending, c("m_kept"))),
    }
    reasons = dict(REASONS)
    for rule, (reason, build) in registry.RULES.items():
        fails[rule], reasons[rule] = build(rules), reason
    enough = (F.coalesce(c("n"), F.lit(0)) >= rules.min_history) & (c("steps") > 0)
    rows = []
    for position, (rule, (failed, measure)) in enumerate(fails.items()):
        if rule in rules.off:
            continue
        passed = ~F.coalesce(failed, F.lit(False))
        rows.append(F.struct(
            F.lit(position).alias("rule_position"), F.lit(rule).alias("rule_id"), passed.alias("passed"),
            F.when(~passed, F.lit(reasons[rule])).alias("reason"), measure.alias("measure"),
        ))
    return out.where(enough).select("group_id", "model_name", F.inline(F.array(*rows)))


def verdicts(judged: DataFrame, outcomes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per (group, model): passed unless a rule failed; too little history is skipped and passes."""
    summed = outcomes.groupBy("group_id", "model_name").agg(
        F.bool_and("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    short = F.when(F.coalesce(F.col("n"), F.lit(0)) < rules.min_history, F.lit("too little history to validate"))
    return judged.select("group_id", "model_name", short.alias("skipped_reason")).join(
        summed, ["group_id", "model_name"], "left"
    ).select(
        "group_id", "model_name", "skipped_reason",
        F.coalesce("passed", F.lit(True)).alias("passed"),
        F.coalesce("failed_rules", F.lit(0).cast("long")).alias("failed_rules"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def evaluate(trained: DataFrame, verdict: DataFrame, scores: DataFrame) -> DataFrame:
    """Evaluation status of every pair: Survived, Eliminated, Failed or Skipped."""
    keys = ["group_id", "model_name"]
    tried = trained.where(F.col("status").isin("Trained", "Failed"))
    joined = tried.join(verdict, keys, "left").join(scores, keys, "left")
    status = (
        F.when(F.col("status") == "Failed", "Failed")
        .when(F.col("n") == 0, "Skipped")
        .when(F.coalesce(F.col("passed"), F.lit(False)), "Survived")
        .otherwise("Eliminated")
    )
    return joined.withColumn("evaluation", status)


def survivors(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("evaluation") == "Survived")


def evaluation_report(evaluated: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("evaluation") == s).alias(s.lower()) for s in ("Survived", "Eliminated", "Failed", "Skipped")]
    return evaluated.agg(*counts, F.coalesce(F.sum("folds"), F.lit(0)).cast("long").alias("folds_evaluated"))
