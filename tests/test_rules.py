"""Reference window and plausibility rules on regime changes, extremes and degenerate inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from keycast.operators import drift, rules


def series_of(spark, histories: dict):
    rows = [(g, i, len(h), dt.date(2000 + i // 12, i % 12 + 1, 1), float(y)) for g, h in histories.items() for i, y in enumerate(h)]
    return spark.createDataFrame(rows, "group_id string, t int, n int, ds date, y double")


def forecasts_of(spark, values: dict):
    rows = [(g, m, s + 1, None if v is None else float(v)) for (g, m), vs in values.items() for s, v in enumerate(vs)]
    return spark.createDataFrame(rows, "group_id string, model_name string, step int, value double")


def failed(spark, histories, values, grain="Monthly", horizon=12):
    series = series_of(spark, histories)
    judged = rules.forecast_facts(forecasts_of(spark, values), rules.history_facts(series, grain, horizon))
    out = rules.rule_outcomes(judged)
    found = {k: set() for k in values}
    for r in out.where("NOT passed").collect():
        found[(r.group_id, r.model_name)].add(r.rule_id)
    return found


@pytest.mark.parametrize("n,grain,h,expected", [
    (156, "Monthly", 12, 36), (156, "Weekly", 12, 104), (156, "Daily", 12, 36), (20, "Monthly", 12, 20), (156, None, 12, 36),
    (156, "Quarterly", 3, 12), (156, "Yearly", 3, 12), (156, "Monthly", 24, 72), (0, "Monthly", 12, 0),
])
def test_window_length(spark, n, grain, h, expected):
    assert spark.range(1).select(rules.window_length(F.lit(n), grain, h).alias("w")).first().w == expected


def test_forecast_that_follows_the_new_regime_survives(spark):
    regime = [20 + i % 3 for i in range(120)] + [100 + i % 5 for i in range(36)]
    out = failed(spark, {"a": regime}, {("a", "good"): [100 + i % 5 for i in range(12)], ("a", "wild"): [500 + i for i in range(12)]})
    band = {"percentile_spike", "iqr_bounds", "excessive_volatility", "forecast_variance", "flat_forecast", "excessive_smoothing"}
    assert not out[("a", "good")] & band
    assert {"percentile_spike", "iqr_bounds", "abnormal_growth"} <= out[("a", "wild")]


def test_missing_seasonality_is_found(spark):
    wave = [100 + 40 * math.sin(2 * math.pi * i / 12) for i in range(150)]
    out = failed(spark, {"s": wave}, {("s", "flat"): [100 + 0.1 * i for i in range(12)], ("s", "wave"): [100 + 40 * math.sin(2 * math.pi * (150 + i) / 12) for i in range(12)]})
    assert "missing_seasonality" in out[("s", "flat")] and "flat_forecast" in out[("s", "flat")]
    assert not out[("s", "wave")]


@pytest.mark.parametrize("level,target", [(60, 300), (100, 1000), (50, 500), (100, 0.5)])
def test_extreme_forecasts_are_eliminated(spark, level, target):
    history = [level + (i % 7) for i in range(60)]
    assert failed(spark, {"x": history}, {("x", "m"): [target + 0.1 * i for i in range(12)]})[("x", "m")]


DEGENERATE = {
    "constant": ([5.0] * 36, [5.0] * 12),
    "zero": ([0.0] * 36, [0.0] * 12),
    "one_point": ([10 + i % 4 for i in range(36)], [11.0]),
    "negative": ([-10 - i % 4 for i in range(36)], [-11.0 - i % 3 for i in range(12)]),
    "huge": ([1e12 + i * 1e9 for i in range(36)], [1.04e12] * 12),
    "tiny": ([1e-12 * (1 + i % 3) for i in range(36)], [1.5e-12] * 12),
    "crossing": ([(-1) ** i * (i % 5) for i in range(36)], [(-1) ** i * 2.0 for i in range(12)]),
}


def test_degenerate_inputs_give_no_nan_and_no_failure(spark):
    series = series_of(spark, {k: h for k, (h, _) in DEGENERATE.items()})
    forecasts = forecasts_of(spark, {(k, "m"): f for k, (_, f) in DEGENERATE.items()})
    judged = rules.forecast_facts(forecasts, rules.history_facts(series, "Monthly", 12))
    rows = rules.rule_outcomes(judged).collect()
    assert len(rows) == 10 * len(DEGENERATE)
    assert all(r.measure is None or not math.isnan(r.measure) for r in rows)
    chosen = drift.choose_algorithm(drift.history_samples(series, "Monthly", 12))
    limits = drift.thresholds(chosen, drift.null_statistics(chosen))
    for r in drift.drift_verdicts(chosen, limits, drift.forecast_samples(forecasts)).collect():
        assert r.statistic is not None and not math.isnan(r.statistic) and r.passed == (r.statistic <= r.threshold)


def test_non_finite_values_fail_only_where_they_should(spark):
    out = failed(spark, {"a": [10 + i % 4 for i in range(36)]}, {("a", "nan"): [11.0] * 11 + [float("nan")], ("a", "inf"): [11.0] * 11 + [float("inf")]})
    assert "non_finite_forecast" in out[("a", "nan")] and "non_finite_forecast" in out[("a", "inf")]


def test_short_history_is_skipped_and_passes(spark):
    series = series_of(spark, {"s": [1.0, 5.0, 2.0]})
    judged = rules.forecast_facts(forecasts_of(spark, {("s", "m"): [900.0] * 12}), rules.history_facts(series, "Monthly", 12))
    row = rules.verdicts(judged, rules.rule_outcomes(judged)).first()
    assert row.passed and row.failed_rules == 0 and row.skipped_reason


def test_forecast_without_finite_values_is_an_error_row(spark):
    series = series_of(spark, {"a": [float(i % 7) for i in range(36)]})
    chosen = drift.choose_algorithm(drift.history_samples(series, "Monthly", 12))
    limits = drift.thresholds(chosen, drift.null_statistics(chosen))
    current = spark.createDataFrame([("a", "m", [])], "group_id string, model_name string, current array<double>")
    row = drift.drift_verdicts(chosen, limits, current).first()
    assert row.error and not row.passed and row.statistic is None
