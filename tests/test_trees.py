"""Pooled trees: calendar borders, recursion, attribution per key, search, and what a run picks up."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from keycast import registry
from keycast.config import Backtest, ConfigurationError, Drift, Importance, ModelSpec, RunOptions, Search
from keycast.operators import drift, folds, results, selection
from keycast.operators.models import trees
from keycast.plans import forecast

SMALL = {"numTrees": 3, "maxDepth": 3}


def month(i: int) -> dt.date:
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


def series_of(spark, values: dict[str, tuple[int, list[float]]]):
    """group → (first month, values) as series rows."""
    rows = [(g, i, month(first + i), float(v), len(ys)) for g, (first, ys) in values.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "group_id string, t int, ds date, y double, n int")


def wave(n: int, seed: int) -> list[float]:
    rnd = random.Random(seed)
    return [100 + i + 20 * math.sin(i / 2) + rnd.random() for i in range(n)]


def test_no_later_month_of_any_key_reaches_a_fold(spark):
    early, late = wave(40, 1), wave(40, 2)
    options = Backtest(min_train=24, horizon=3, max_folds=4, strategy="expanding")

    def backtest(late_values):
        frame = folds.frame(series_of(spark, {"early": (0, early), "late": (7, late_values)}), options, 6)
        days = trees.borders(frame)
        assert len(days) == 8  # 4 ends of training of each key
        made = trees.predict(frame.where("fold >= 0"), "random_forest", SMALL)
        return {(r.group_id, r.fold, r.step): r.value for r in made.collect()}

    # Months of `late` after the first end of training of `early` change; that fold of `early` must not.
    end = 24
    changed = [v if 7 + i < end else v * 9 + 500 for i, v in enumerate(late)]
    before, after = backtest(late), backtest(changed)
    assert len(before) == 24
    assert [before["early", 0, s] for s in (1, 2, 3)] == [after["early", 0, s] for s in (1, 2, 3)]
    assert before["late", 3, 1] != after["late", 3, 1]


def test_borders_are_few_and_the_earliest_stays(spark):
    values = {f"g{k}": (k, wave(36, k)) for k in range(12)}
    frame = folds.frame(series_of(spark, values), Backtest(), 6)
    days = trees.borders(frame, most=5)
    assert len(days) == 5 and days[0] == month(11)
    placed = trees.with_border(frame, days)
    assert placed.select("group_id", "fold").distinct().count() == 12 * 6
    late = placed.where("part = 'train' AND fold >= 0").groupBy("group_id", "fold", "border").agg(F.max("ds").alias("end"))
    assert all(days[r.border] <= r.end and (r.border + 1 == len(days) or days[r.border + 1] > r.end) for r in late.collect())


def test_recursion_takes_jobs_by_horizon_not_by_folds(spark):
    frame = folds.frame(series_of(spark, {"a": (0, wave(40, 1))}), Backtest(), 6)
    made = trees.predict(frame, "random_forest", SMALL, horizon=6)
    counts = {r.fold: r["count"] for r in made.groupBy("fold").count().collect()}
    assert counts == {-1: 6, 0: 3, 1: 3, 2: 3, 3: 3, 4: 3}
    assert made.where("value IS NULL OR isnan(value)").isEmpty()


def test_missing_regressors_count_as_the_mean_in_training_and_forecasts(spark):
    rows = series_of(spark, {"a": (0, wave(40, 1))}).withColumn("promo", F.when(F.col("t") % 5 != 0, F.col("t") % 3).cast("double"))
    frame = folds.frame(rows, Backtest(), 6, ["promo"]).where("fold = -1")
    matrix = trees.training_rows(frame, ["promo"], [])
    missing = matrix.where("t % 5 = 0").select("promo").distinct().collect()
    assert [r.promo for r in missing] == [0.0] and matrix.count() > 20
    state = trees.states(trees.with_border(frame, []), ["promo"])
    first = trees._step_features(state, 1, ["promo"]).first()
    assert first.promo == pytest.approx(0.0) if first.tests[0].promo is None else first.promo == pytest.approx((first.tests[0].promo - first.mean_promo) / first.width_promo)


def test_keys_with_different_drivers_get_different_features(spark):
    rnd = random.Random(5)
    rows = []
    for t in range(60):
        for key in ("by_a", "by_b"):
            a, b = rnd.random(), rnd.random()
            rows.append((key, t, a, b, 5.0 * (a if key == "by_a" else b), 1.0))
    table = spark.createDataFrame(rows, "group_id string, t int, a double, b double, label double, width double")
    score = lambda r: r.withColumn("change", 5.0 * F.when(F.col("group_id") == "by_a", F.col("a")).otherwise(F.col("b")))
    found = trees.gains(table, score, ["a", "b"], (42, 7))
    made = trees.attributed(found, "m", Importance(resamples=4))
    point = {(r.group_id, r.feature): r.weight for r in made["point"].collect()}
    assert point == {("by_a", "a"): 1.0, ("by_a", "b"): 0.0, ("by_b", "a"): 0.0, ("by_b", "b"): 1.0}
    vectors = {r.vector_id for r in made["window"].select("vector_id").distinct().collect()}
    assert vectors == {"resample_0", "resample_1", "resample_2", "resample_3", "segment_0", "segment_1"}
    # Shuffles stay inside a key and use every value once.
    gain = found.where("feature = 'a' AND group_id = 'by_a' AND seed = 42").count()
    assert gain == 60


def test_pooled_forest_tells_keys_apart_and_holds_rows_out(spark):
    rnd = random.Random(3)
    values = {"season": (0, [100 + 40 * math.sin(2 * math.pi * i / 12) for i in range(72)]), "noise": (0, [100 + 40 * rnd.random() for _ in range(72)])}
    matrix = trees.training_rows(folds.frame(series_of(spark, values), Backtest(), 6).where("fold = -1"), days=[])
    records = {r.group_id: r for r in trees.importance_records(matrix, "random_forest", params=SMALL).collect()}
    assert set(records) == {"season", "noise"} and all(r.method == "native_importance" and 0 <= r.importance_score <= 1 for r in records.values())
    held = trees.importance_records(matrix, "random_forest", Importance(holdout=True), params=SMALL).collect()
    assert {r.method for r in held} == {"permutation"} and len(held) == 2
    rows = matrix.withColumn("h", trees.held_back(matrix)).groupBy("group_id").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("int")).alias("h")).collect()
    assert all(r.h == min(max(3, r.n // 5), 12) for r in rows)


def test_search_halves_and_tells_why(spark):
    table = series_of(spark, {"a": (0, wave(80, 1)), "b": (5, wave(30, 2))})
    matrix = trees.training_rows(folds.frame(table, Backtest(), 6).where("fold = -1"), days=[])
    options = Search(trials=4, splits=3)
    trials = trees.search(matrix, "random_forest", options)
    seen = [r["count"] for r in trials.groupBy("split").count().orderBy("split").collect()]
    assert seen == [4, 2, 1]
    params, was_tuned, reason = trees.tuned(trials, "random_forest", options)
    best = trials.where("place = 1").first()
    assert was_tuned and json.loads(best.params) == params and "4 settings" in reason
    firsts = {r.trial: r.mae for r in trials.where("split = 0").collect()}
    went_on = {r.trial for r in trials.where("split = 0 AND went_on").collect()}
    assert went_on == set(sorted(firsts, key=lambda t: (firsts[t], t))[:2])
    none = trees.search(matrix.where("group_id = 'b'"), "random_forest", options)
    assert none.count() == 0 and trees.tuned(none, "random_forest", options)[:2] == (trees.DEFAULTS["random_forest"], False)
    assert len({json.dumps(s, sort_keys=True) for s in trees.settings_tried("boosted_trees", Search())}) == 8


def test_a_run_tunes_and_keeps_to_the_chosen_features(spark):
    rows = series_of(spark, {"a": (0, wave(64, 1)), "b": (0, wave(64, 2))})
    options = RunOptions(models=("random_forest",), horizon=6, search=Search(trials=2, splits=2), derived_features=("lag_1", "month"), importance=Importance(resamples=1))
    run = forecast.forecast_series(rows, "Monthly", options)
    chosen = run.tuning.collect()
    assert [(r.model_name, r.tuned) for r in chosen] == [("random_forest", True)] and run.trials.count() == 3
    assert run.forecasts.count() == 12 and run.forecasts.where("value IS NULL").isEmpty()
    none = rows.sparkSession.createDataFrame([], "group_id string, model_name string, params map<string,string>")
    records = {r.model_name: r for r in results.hyperparameters(run.trained, run.scores, run.ranked, run.selection, none, run.tuning).where("group_id = 'a'").collect()}
    assert records["random_forest"].tuned and records["random_forest"].params == {k: str(v) for k, v in json.loads(chosen[0].params).items()}
    drivers = {r.dominant_feature for r in run.explained.collect()}
    assert drivers <= {"time_index", "lag_1", "month", None}
    with pytest.raises(ConfigurationError):
        forecast.predict(rows, RunOptions(models=("random_forest",), derived_features=("lag_99",)))


def test_registered_parts_join_a_run(spark):
    def last_value(frame, regressors):
        last = frame.where("part = 'train'").groupBy("group_id", "fold").agg(F.max_by("y", "t").alias("value"))
        rows = frame.where("part = 'test'").join(last, ["group_id", "fold"])
        none = F.lit(None).cast("double")
        return rows.select("group_id", F.lit("last_value").alias("model_name"), "fold", "step", "ds", F.col("y").alias("actual"), (F.col("value") + F.col("step")).alias("value"), none.alias("lower"), none.alias("upper"))

    rows = series_of(spark, {"a": (0, wave(48, 1))})
    options = RunOptions(models=("trend_seasonal", "last_value"), horizon=6)
    registry.register_model(ModelSpec("last_value", 2), last_value)
    registry.register_rule("too_high", "Above The Ceiling", lambda rules: (F.col("f_mean") > 1e6, F.col("f_mean")))
    registry.register_rule("never_good", "Never Good", lambda rules: (F.col("model_name") == "trend_seasonal", F.lit(1.0)))
    registry.register_statistic("mean_gap", lambda a, b: F.abs(F.element_at(a, 1) - F.element_at(b, 1)))
    registry.register_null("whole", lambda n: F.array(F.struct(F.lit(0).alias("iteration"), F.col("history").alias("a"), F.col("history").alias("b"))))
    try:
        with pytest.raises(ConfigurationError):
            registry.register_rule("too_high", "x", lambda rules: (F.lit(True), F.lit(0.0)))
        run = forecast.forecast_series(rows, "Monthly", options)
        outcomes = {(r.model_name, r.rule_id): r.passed for r in run.rules.collect()}
        assert outcomes["last_value", "too_high"] and not outcomes["trend_seasonal", "never_good"]
        reasons = {r.model_name: r.reasons for r in run.verdicts.collect()}
        assert "Never Good" in reasons["trend_seasonal"] and {r.model_name for r in run.evaluated.collect()} == {"trend_seasonal", "last_value"}
        assert {r.model_name for r in run.ranked.collect()} <= {"last_value"}
        own = Drift(algorithm="mean_gap", method="whole")
        chosen = drift.choose_algorithm(drift.history_samples(rows, "Monthly", 6), own)
        limit = drift.thresholds(chosen, drift.null_statistics(chosen, own), own).first()
        assert chosen.first().algorithm == "mean_gap" and (limit.method, limit.threshold, limit.null_size) == ("whole", 0.0, 1)
    finally:
        for name in ("last_value", "too_high", "never_good", "mean_gap", "whole"):
            registry.withdraw(name)
    with pytest.raises(ConfigurationError):
        forecast.forecast_series(rows, "Monthly", options)


def test_a_failed_step_is_listed_and_leaves_others_alone(spark):
    ranked = spark.createDataFrame([("a", "m", 1, 1, 0.5), ("b", "m", 1, 1, 0.5)], "group_id string, model_name string, backtest_rank int, final_rank int, composite_score double")
    gate = spark.createDataFrame([("a", "m", True, None), ("b", "m", False, "No finite values to compare.")], "group_id string, model_name string, passed boolean, error string")
    gate = gate.select("*", F.lit("ks").alias("algorithm"), F.lit("bootstrap").alias("method"), F.lit(0.1).alias("statistic"), F.lit(0.2).alias("threshold"), F.lit("why").alias("detail"))
    trained = spark.createDataFrame([("a", "m", "Trained", None), ("b", "m", "Trained", None), ("c", "m", "Failed", None), ("d", "m", "Skipped", "short")], "group_id string, model_name string, status string, detail string")
    judged = selection.judged_candidates(ranked, gate)
    groups = trained.select("group_id")
    nothing = spark.createDataFrame([("c", None)], "group_id string, value double")
    made = selection.select_production(groups, judged, nothing, selection.failures(trained, judged))
    status = {r.group_id: (r.status, r.failure_reason) for r in made.collect()}
    assert status["a"] == ("Selected", None) and status["d"] == ("No Model Available", None)
    assert status["b"] == ("Failed", "drift m: No finite values to compare.") and status["c"][0] == "Failed"
    assert selection.selection_report(made).first().failed == 2
