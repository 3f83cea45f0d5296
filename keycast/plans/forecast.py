"""A whole run as one lazy chain of operators."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast import registry
from keycast.config import ConfigurationError, DataError, Roles, RunOptions, check_horizon, resolve_features, resolve_models
from keycast.functions.skew import spread, stable
from keycast.operators import importance as explain
from keycast.operators import clean, drift, folds, metrics, profile, ranking, rules, selection, training
from keycast.operators import series as series_ops
from keycast.operators.models import autoregressive, naive, trees, trend

RECORD = (
    "group_id string, model_name string, method string, window_stability double, horizon_stability double, "
    "plausibility double, dominant_feature string, importance_score double"
)
FORECASTERS = {"trend_seasonal": trend.predict, "autoregressive": lambda frame, regressors=(): autoregressive.predict(frame)}
TUNING = "model_name string, params string, tuned boolean, reason string"


@dataclass
class Run:
    """Result tables of a run; nothing is collected to the driver."""

    series: DataFrame
    trained: DataFrame
    predictions: DataFrame
    forecasts: DataFrame
    naive: DataFrame
    scores: DataFrame
    judged_forecasts: DataFrame
    rules: DataFrame
    verdicts: DataFrame
    evaluated: DataFrame
    explained: DataFrame
    ranked: DataFrame
    chosen: DataFrame
    thresholds: DataFrame
    drift: DataFrame
    judged: DataFrame
    selection: DataFrame
    winning: DataFrame
    tuning: DataFrame
    trials: DataFrame


def tune(series: DataFrame, options: RunOptions = RunOptions(), regressors: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The setting each searched family is fitted with (see `TUNING`), and the trials behind it."""
    spark, chosen, trials = series.sparkSession, [], []
    for spec in _specs(options):
        if not spec.searched:
            continue
        if options.search is None:
            chosen.append((spec.name, json.dumps(trees.DEFAULTS[spec.name], sort_keys=True), False, "No search was asked for."))
            continue
        frame = folds.frame(series, options.backtest, options.horizon, regressors).where((F.col("n") >= spec.min_rows) & (F.col("fold") == folds.FORWARD))
        tried = trees.search(trees.training_rows(frame, regressors, spec=_derived(options)), spec.name, options.search, regressors, _derived(options))
        params, tuned, reason = trees.tuned(tried, spec.name, options.search)
        chosen.append((spec.name, json.dumps(params, sort_keys=True), tuned, reason))
        trials.append(tried)
    none = spark.createDataFrame([], "model_name string, trial int, params string, split int, mae double, went_on boolean, place int")
    return spark.createDataFrame(chosen, TUNING), reduce(DataFrame.unionByName, trials, none)


def predict(series: DataFrame, options: RunOptions = RunOptions(), regressors: list[str] = (), settings: dict | None = None) -> DataFrame:
    """Backtest and forward predictions of every requested model, one long table; `settings` holds those of searched families."""
    parts, frames = [], {}
    for spec in _specs(options):
        kept = list(regressors) if spec.takes_features else []
        if tuple(kept) not in frames:
            frames[tuple(kept)] = folds.frame(series, options.backtest, options.horizon, kept)
        frame = frames[tuple(kept)].where(F.col("n") >= spec.min_rows)
        closed_form = FORECASTERS | registry.FORECASTERS
        if spec.name in closed_form:
            parts.append(closed_form[spec.name](frame, kept))
        else:
            params = (settings or {}).get(spec.name)
            parts.append(trees.predict(frame, spec.name, params, options.horizon, options.backtest.horizon, kept, _derived(options)))
    return reduce(DataFrame.unionByName, parts)


def explain_models(series: DataFrame, options: RunOptions, regressors: list[str] = (), settings: dict | None = None) -> DataFrame:
    """Importance records of the tree models; the closed-form models have nothing to permute."""
    parts = [series.sparkSession.createDataFrame([], RECORD)]
    for spec in _specs(options):
        if spec.name in trees.DEFAULTS:
            frame = folds.frame(series, options.backtest, options.horizon, regressors).where((F.col("n") >= spec.min_rows) & (F.col("fold") == folds.FORWARD))
            matrix = stable(trees.training_rows(frame, regressors, spec=_derived(options)))
            if not matrix.isEmpty():
                records = trees.importance_records(matrix, spec.name, options.importance, regressors, (settings or {}).get(spec.name), _derived(options))
                parts.append(records.select(*parts[0].columns))
    return reduce(DataFrame.unionByName, parts)


def forecast_series(series: DataFrame, grain: str | None, options: RunOptions = RunOptions(), regressors: list[str] = ()) -> Run:
    """Train, backtest, screen, rank, gate and select for every series at once.

    Tables that several later stages read (series, predictions, evaluation,
    ranking, drift) are written to the shared checkpoint folder: each is
    computed once, plans stay small, and a lost executor re-reads them.
    """
    horizon = check_horizon(options.horizon)
    series = spread(stable(series), "group_id")
    facts = series.groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    tuning, trials = tune(series, options, regressors)
    settings = {r.model_name: json.loads(r.params) for r in tuning.collect()}  # a row per searched family
    predictions = stable(predict(series, options, regressors, settings))
    forecasts = predictions.where("fold = -1")
    baseline = naive.predict(folds.frame(series, options.backtest, horizon).where("fold = -1"))
    trained = training.mark_failed(training.eligibility(facts, _specs(options)), forecasts, horizon)
    scores = metrics.overall(predictions)
    past = rules.history_facts(series, grain, horizon, options.rules)
    judged_forecasts = stable(rules.forecast_facts(forecasts, past, options.rules))
    outcomes = rules.rule_outcomes(judged_forecasts, options.rules)
    verdicts = rules.verdicts(judged_forecasts, outcomes, options.rules)
    evaluated = stable(rules.evaluate(trained, verdicts, scores))
    alive = rules.survivors(evaluated)
    records = explain_models(series, options, regressors, settings)
    explained = stable(explain.for_survivors(alive, records, options.importance))
    ranked = stable(ranking.rank_models(alive, forecasts, explained, options.ranking))
    chosen = stable(drift.choose_algorithm(drift.history_samples(series, grain, horizon), options.drift))
    limits = stable(drift.thresholds(chosen, drift.key_nulls(chosen, options.drift), options.drift))
    kept = ranked.select("group_id", "model_name")
    current = drift.forecast_samples(forecasts.join(kept, ["group_id", "model_name"], "left_semi"))
    drifted = stable(drift.drift_verdicts(chosen, limits, current))
    judged = selection.judged_candidates(ranked, drifted)
    production = stable(selection.select_production(facts, judged, baseline, selection.failures(trained, judged)))
    return Run(
        series=series, trained=trained, predictions=predictions, forecasts=forecasts, naive=baseline, scores=scores,
        judged_forecasts=judged_forecasts, rules=outcomes, verdicts=verdicts, evaluated=evaluated, explained=explained, ranked=ranked,
        chosen=chosen, thresholds=limits, drift=drifted, judged=judged, selection=production,
        winning=selection.winning_forecasts(production, forecasts, baseline), tuning=tuning, trials=trials,
    )


def _derived(options: RunOptions) -> dict | None:
    """The chosen derived features; unknown names are refused."""
    if options.derived_features is None:
        return None
    chosen = resolve_features(list(options.derived_features))
    if chosen["rejected"]:
        raise ConfigurationError(f"Not a derived feature: {', '.join(chosen['rejected'])}.")
    return chosen


def _specs(options: RunOptions):
    return resolve_models(list(options.models) if options.models else None)


def run(table: DataFrame, roles: Roles, options: RunOptions = RunOptions(), order: list[str] | None = None) -> Run:
    """From a raw table to selected forecasts; stops with a clear error where the data cannot be used."""
    roles.check(table.columns)
    grain = profile.frequency(table, roles.date).first().frequency
    report = profile.suitability(profile.quality_report(table.select(*dict.fromkeys(roles.columns)), roles, grain, options.quality), roles, options.quality).first()
    if report.suitability == "Not Suitable":
        raise DataError(f"The data cannot be forecast: {', '.join(report.reasons)}.")
    # Written once: the gates and the series below read the curated rows, not the raw table again.
    curated = stable(clean.prepare(table, roles, grain, options.cleaning, order))
    clean.assert_usable(curated, roles, options.cleaning)
    clean.verify(curated, roles, options.cleaning)
    series = series_ops.build_series(curated, roles, options.cleaning)
    return forecast_series(series, grain, options, series_ops.usable_features(curated, roles))
