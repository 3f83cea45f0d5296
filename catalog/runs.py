"""Views over a finished run, run history, call telemetry and workload estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import query
from catalog.decisions import DECISION, EXPORT, RANKED
from catalog.fixtures import AUTO, CLOSED_FORM, FRAME, SERIES, SUPPLIER_ROLES, folder, materialized, once, supplier_run, supplier_series, table, with_
from catalog.modelling import METRIC_SQL, customer_sizes, long, r_, rounded
from keycast.config import OLD_STAGE_NAMES, STAGES
from keycast.functions.skew import stable
from keycast.operators import metrics, results, rules, telemetry, training, workload
from keycast.operators import series as series_ops
from keycast.operators.models import autoregressive
from keycast.operators import folds
from keycast.sources import tables

# -- confidence and decisions -----------------------------------------------------------

_SHAPES = """shapes AS (SELECT w.group_id, w.model_name, stddev_pop(value) AS f_std, any_value(window_std) AS window_std FROM winning w JOIN past USING (group_id) GROUP BY 1, 2),
decided0 AS (SELECT k.*, s.wmape, s.rmse, s.mae, f_std, window_std, greatest(0, least(1, (100 - wmape) / 100)) AS backtest_accuracy, least(f_std / nullif(window_std, 0), 1 / nullif(f_std / nullif(window_std, 0), 0)) AS close,
    CASE WHEN threshold > 0 THEN greatest(0, least(1, 1 - statistic / threshold)) END AS drift_margin FROM picked k LEFT JOIN scores s USING (group_id, model_name) LEFT JOIN shapes USING (group_id, model_name)),
decided1 AS (SELECT *, CASE WHEN f_std <= 0 THEN 0 ELSE greatest(0, least(1, (close - 0.25) / 0.75)) END AS forecast_stability FROM decided0),
decided AS (SELECT *, (coalesce(0.5 * backtest_accuracy, 0) + coalesce(0.3 * forecast_stability, 0) + coalesce(0.2 * drift_margin, 0)) / nullif((CASE WHEN backtest_accuracy IS NULL THEN 0 ELSE 0.5 END)
    + (CASE WHEN forecast_stability IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN drift_margin IS NULL THEN 0 ELSE 0.2 END), 0) AS confidence FROM decided1)"""
_DECIDED = (*DECISION, EXPORT, _SHAPES)


def decided(spark, sf) -> DataFrame:
    def build():
        run = supplier_run(spark, sf)
        facts = rules.forecast_facts(run.winning, rules.history_facts(run.series, "Monthly", 12))
        return stable(results.decisions(run.selection, run.scores, facts))

    return once(spark, f"decided:{sf}", build)


@query("result_confidence", with_(*_DECIDED) + f"SELECT group_id, {r_(6, 'backtest_accuracy', 'forecast_stability', 'drift_margin', 'confidence')} FROM decided")
def _(spark, sf):
    return decided(spark, sf).select("group_id", *rounded(6, "backtest_accuracy", "forecast_stability", "drift_margin", "confidence"))


@query("result_confidence_text", with_(*_DECIDED) + """SELECT group_id, array_to_string(list_filter([CASE WHEN backtest_accuracy IS NOT NULL THEN CAST(round(50 / w) AS BIGINT) || '% x backtest accuracy' END,
    CASE WHEN forecast_stability IS NOT NULL THEN CAST(round(30 / w) AS BIGINT) || '% x forecast stability' END, CASE WHEN drift_margin IS NOT NULL THEN CAST(round(20 / w) AS BIGINT) || '% x drift margin' END], lambda x: x IS NOT NULL), ' + ')
    || CASE WHEN drift_margin IS NOT NULL THEN '' WHEN fallback_used THEN ' (drift margin not applicable - fallback path)' ELSE ' (drift data unavailable)' END AS formula FROM (SELECT *,
    (CASE WHEN backtest_accuracy IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN forecast_stability IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN drift_margin IS NULL THEN 0 ELSE 0.2 END) AS w FROM decided)""")
def _(spark, sf):
    return decided(spark, sf).select("group_id", "formula")


@query("result_model_decision", with_(*_DECIDED) + "SELECT group_id, model_name, status, fallback_used, round(confidence, 4) AS confidence, CAST(final_rank AS BIGINT) AS final_rank FROM decided")
def _(spark, sf):
    return decided(spark, sf).select("group_id", "model_name", "status", "fallback_used", F.round("confidence", 4).alias("confidence"), *long("final_rank"))


@query("result_underlying_metrics", with_(*_DECIDED) + """SELECT group_id, coalesce(algorithm, '—') AS drift_test, coalesce(method, '—') AS threshold_method, round(threshold, 6) AS threshold, round(statistic, 6) AS statistic,
    round(wmape, 6) AS wmape, round(rmse, 2) AS rmse, round(mae, 2) AS mae, CASE WHEN statistic <= threshold THEN 'Passed' ELSE 'Not Passed' END AS validation_result FROM decided""")
def _(spark, sf):
    out = results.underlying_metrics(decided(spark, sf))
    return out.select("group_id", "drift_test", "threshold_method", *rounded(6, "threshold", "statistic", "wmape"), *rounded(2, "rmse", "mae"), "validation_result")


_MODELS = """detail AS (SELECT coalesce(e.group_id, k.group_id) AS group_id, coalesce(e.model_name, k.model_name) AS model_name, e.evaluation, e.reasons, r.final_rank, k.model_name IS NOT NULL AS is_winner, coalesce(k.fallback_used, false) AS fb,
    w.winner_rank, w.statistic, w.threshold, w.algorithm, w.method, w.passed AS gate FROM evaluated e FULL JOIN picked k ON k.group_id = e.group_id AND k.model_name = e.model_name LEFT JOIN ranked r ON r.group_id = e.group_id AND r.model_name = e.model_name
    LEFT JOIN walk w ON w.group_id = e.group_id AND w.model_name = e.model_name),
outcome AS (SELECT *, final_rank IS NOT NULL AND (winner_rank IS NULL OR final_rank < winner_rank) AS was_rejected FROM detail)"""


def models_of(spark, sf) -> DataFrame:
    def build():
        run = supplier_run(spark, sf)
        return stable(results.evaluated_models(run.trained, run.evaluated, run.ranked, run.selection, run.judged))

    return once(spark, f"models:{sf}", build)


@query("result_evaluated_models", with_(*DECISION, _MODELS) + "SELECT group_id, model_name, evaluation, coalesce(reasons, '') AS reasons, CAST(final_rank AS BIGINT) AS final_rank, is_winner FROM outcome")
def _(spark, sf):
    out = models_of(spark, sf)
    return out.select("group_id", "model_name", "evaluation", F.coalesce("reasons", F.lit("")).alias("reasons"), *long("final_rank"), "is_winner")


@query("result_selection_outcome", with_(*DECISION, _MODELS) + """SELECT group_id, model_name, CASE WHEN is_winner AND fb THEN 'Fallback Used' WHEN is_winner THEN 'Selected' WHEN was_rejected THEN 'Rejected'
    WHEN evaluation = 'Eliminated' THEN 'Eliminated — ' || reasons ELSE 'Not reached — a higher-ranked candidate already passed drift validation' END AS outcome FROM outcome""")
def _(spark, sf):
    label = F.when(F.col("outcome").startswith("Rejected"), F.lit("Rejected")).otherwise(F.col("outcome"))
    return models_of(spark, sf).select("group_id", "model_name", label.alias("outcome"))


@query("result_drift_detail", with_(*DECISION, _MODELS) + """SELECT group_id, model_name, CASE WHEN is_winner THEN NOT fb ELSE true END AS drift_evaluated, CASE WHEN NOT fb THEN algorithm END AS algorithm, round(statistic, 6) AS statistic, gate AS passed
    FROM outcome WHERE is_winner OR was_rejected""")
def _(spark, sf):
    out = models_of(spark, sf).where("is_winner OR was_rejected")
    return out.select("group_id", "model_name", "drift_evaluated", "algorithm", F.round("statistic", 6).alias("statistic"), "passed")


# -- chart tables ---------------------------------------------------------------------------

_LABELS = """gaps AS (SELECT group_id, ds, date_diff('day', lag(ds) OVER (PARTITION BY group_id ORDER BY t), ds) AS g FROM series),
per AS (SELECT group_id, max(ds) AS last, list_sort(list(g) FILTER (g > 0)) AS gs FROM gaps GROUP BY 1),
labels AS (SELECT group_id, s + 1 AS step, CASE WHEN gs[len(gs) // 2 + 1] BETWEEN 26 AND 35 THEN CAST(last + to_months(CAST(s + 1 AS INTEGER)) AS DATE) ELSE last + CAST(gs[len(gs) // 2 + 1] * (s + 1) AS INTEGER) END AS label FROM per, range(12) r(s))"""


@query("result_projected_labels", with_(SERIES, _LABELS) + "SELECT group_id, step, label FROM labels")
def _(spark, sf):
    return results.projected_labels(supplier_series(spark, sf), 12).select("group_id", *long("step"), "label")


@query("result_actual_vs_forecast", with_(*DECISION, EXPORT, _LABELS) + """SELECT s.group_id, CAST(t + 1 AS BIGINT) AS position, CAST(ds AS VARCHAR) AS period, ds, round(y, 4) AS actual, CASE WHEN t = n - 1 THEN round(y, 4) END AS forecast, t = n - 1 AS boundary FROM series s
    UNION ALL SELECT w.group_id, n + step, 'T' || step, label, NULL, round(value, 4), false FROM winning w JOIN labels USING (group_id, step) JOIN (SELECT DISTINCT group_id, n FROM series) z USING (group_id)""".replace("round(value, 4)", "round(value, 2)"))
def _(spark, sf):
    run = supplier_run(spark, sf)
    out = results.actual_vs_forecast(run.series, run.winning)
    value = F.when(F.col("actual").isNull(), F.round("forecast", 2)).otherwise(F.round("forecast", 4))
    return out.select("group_id", *long("position"), "period", "ds", F.round("actual", 4).alias("actual"), value.alias("forecast"), "boundary")


@query("result_per_key_outcomes", with_(*DECISION) + """SELECT group_id, model_name, status, fallback_used, CAST(backtest_rank AS BIGINT) AS backtest_rank, round(greatest(0, 100 - wmape), 2) AS accuracy FROM picked LEFT JOIN scores USING (group_id, model_name)""")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.per_key_outcomes(run.selection, run.scores).select("group_id", "model_name", "status", "fallback_used", *long("backtest_rank"), "accuracy")


@query("result_run_summary", with_(*DECISION) + """SELECT count(*) AS keys_processed, count(*) FILTER (fallback_used) AS fallback_used, round(avg(round(greatest(0, 100 - wmape), 2)), 2) AS average_accuracy FROM picked LEFT JOIN scores USING (group_id, model_name)""")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.run_summary(results.per_key_outcomes(run.selection, run.scores))


_PARAMS = "params AS (SELECT group_id, 'autoregressive' AS model_name, CAST(p AS VARCHAR) AS p, CAST(d AS VARCHAR) AS d FROM ar_fit WHERE fold = -1)"


def order_params(spark, sf) -> DataFrame:
    fits = autoregressive.fits(folds.frame(supplier_series(spark, sf))).where("fold = -1")
    values = F.create_map(F.lit("p"), F.col("p").cast("string"), F.lit("d"), F.col("d").cast("string"))
    return fits.select("group_id", F.lit("autoregressive").alias("model_name"), values.alias("params"))


@query("result_hyperparameters", materialized(with_(*DECISION, _PARAMS), "frame", "ar_fit", "picked", "scores", "ranked", "series", "predictions", "months") + """SELECT s.group_id, s.model_name, coalesce(k.model_name = s.model_name, false) AS is_winner, false AS is_fallback, CASE WHEN k.model_name = s.model_name THEN 'Winner' ELSE 'Rejected' END AS status, round(wmape, 6) AS wmape,
    CAST(r.final_rank AS BIGINT) AS final_rank, p.p, p.d FROM scores s LEFT JOIN picked k ON k.group_id = s.group_id LEFT JOIN ranked r ON r.group_id = s.group_id AND r.model_name = s.model_name LEFT JOIN params p ON p.group_id = s.group_id AND p.model_name = s.model_name
    UNION ALL SELECT group_id, model_name, true, true, 'Fallback', NULL, NULL, NULL, NULL FROM picked WHERE fallback_used""".replace("round(wmape, 6)", "round(s.wmape, 6)"))
def _(spark, sf):
    run = supplier_run(spark, sf)
    out = results.hyperparameters(run.trained, run.scores, run.ranked, run.selection, order_params(spark, sf))
    return out.select("group_id", "model_name", "is_winner", "is_fallback", "status", F.round("wmape", 6).alias("wmape"), *long("final_rank"), F.col("params")["p"].alias("p"), F.col("params")["d"].alias("d"))


@query("result_hyperparameter_orders", with_(FRAME, AUTO, _PARAMS) + "SELECT group_id, 'autoregressive' AS model_name, p, d FROM params")
def _(spark, sf):
    run = supplier_run(spark, sf)
    out = results.hyperparameters(run.trained, run.scores, run.ranked, run.selection, order_params(spark, sf))
    return out.where("model_name = 'autoregressive'").select("group_id", "model_name", F.col("params")["p"].alias("p"), F.col("params")["d"].alias("d"))


@query("result_status_counts", with_(*RANKED) + "SELECT 'training' AS stage, 'Trained' AS status, count(*) AS pairs FROM scores UNION ALL SELECT 'evaluation', evaluation, count(*) FROM evaluated GROUP BY 2")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.status_counts(run.trained, run.evaluated)


@query("result_accuracy_by_key", with_(*DECISION) + "SELECT group_id, round(greatest(0, 100 - wmape), 6) AS accuracy, fallback_used, greatest(0, 100 - wmape) >= 70 AS meets_target FROM picked JOIN scores USING (group_id, model_name)")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.accuracy_by_key(results.per_key_outcomes(run.selection, run.scores)).withColumn("accuracy", F.round("accuracy", 6))


@query("result_model_comparison", with_(*DECISION) + "SELECT s.group_id, s.model_name, round(wmape, 6) AS wmape, rank() OVER (PARTITION BY s.group_id ORDER BY wmape) AS place, coalesce(k.model_name = s.model_name, false) AS is_winner FROM scores s LEFT JOIN picked k ON k.group_id = s.group_id")
def _(spark, sf):
    run = supplier_run(spark, sf)
    out = results.model_comparison(run.scores, run.selection)
    return out.select("group_id", "model_name", F.round("wmape", 6).alias("wmape"), *long("place"), "is_winner")


@query("result_distribution_overlay", with_(*DECISION, EXPORT) + """, both_sides AS (SELECT group_id, 'history' AS side, y AS v FROM series WHERE t >= n - 24 UNION ALL SELECT group_id, 'forecast', value FROM winning),
    ranged AS (SELECT *, min(v) OVER (PARTITION BY group_id, side) AS lo, max(v) OVER (PARTITION BY group_id, side) AS hi FROM both_sides)
    SELECT group_id, side, CAST(least(floor((v - lo) / (hi - lo) * 12), 11) AS BIGINT) AS bin, count(*) AS rows_in_bin FROM ranged GROUP BY 1, 2, 3""")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.distribution_overlay(series_ops.recent_history(run.series), run.winning).select("group_id", "side", *long("bin"), "rows_in_bin")


@query("result_ranking_matrix", with_(*RANKED) + f"SELECT group_id, model_name, {r_(6, 'backtest_score', 'stability_score', 'importance_score', 'composite_score')} FROM ranked")
def _(spark, sf):
    out = results.ranking_matrix(supplier_run(spark, sf).ranked)
    return out.select("group_id", "model_name", *rounded(6, "backtest_score", "stability_score", "importance_score", "composite_score"))


@query("result_fold_trend", with_(*DECISION) + f", trend_rows AS (SELECT group_id, model_name, fold, {METRIC_SQL}, count(*) OVER (PARTITION BY group_id, model_name) AS k FROM predictions WHERE fold >= 0 GROUP BY 1, 2, 3) "
       "SELECT t.group_id, t.model_name, CAST(fold AS BIGINT) AS fold, round(t.wmape, 6) AS wmape FROM trend_rows t JOIN picked USING (group_id, model_name) WHERE k > 1")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.fold_trend(metrics.backtest_views(run.predictions), run.selection).select("group_id", "model_name", *long("fold"), F.round("wmape", 6).alias("wmape"))


_FLAT = " UNION ALL ".join(
    [f"SELECT 'backtest.' || group_id || '.' || model_name || '.{c}' AS metric, round({c}, {2 if c in ('rmse', 'mae') else 6}) AS value FROM scores WHERE {c} IS NOT NULL" for c in ("mape", "wmape", "rmse", "mae", "smape", "accuracy")]
    + ["SELECT 'validation.' || group_id || '.' || model_name || '.survived', CASE WHEN evaluation = 'Survived' THEN 1.0 ELSE 0.0 END FROM evaluated"]
    + [f"SELECT 'ranking.' || group_id || '.' || model_name || '.{c}', round(CAST({c} AS DOUBLE), 6) FROM ranked" for c in ("composite_score", "final_rank")]
    + ["SELECT 'drift.' || group_id || '.statistic', round(statistic, 6) FROM picked WHERE statistic IS NOT NULL", "SELECT 'threshold.' || group_id || '.value', round(threshold, 6) FROM picked WHERE threshold IS NOT NULL",
       "SELECT 'selection.' || group_id || '.selected', 1.0 FROM picked", "SELECT 'selection.' || group_id || '.composite_score', round(composite_score, 6) FROM picked WHERE composite_score IS NOT NULL",
       "SELECT 'training.trained', CAST(count(*) AS DOUBLE) FROM scores", *[f"SELECT 'training.{c}', CAST(0 AS DOUBLE)" for c in ("failed", "skipped", "unavailable")]])


@query("result_flat_metrics", with_(*DECISION) + _FLAT)
def _(spark, sf):
    run = supplier_run(spark, sf)
    out = results.flat_metrics(training.training_report(run.trained), run.scores, run.evaluated, run.ranked, run.selection)
    money = F.col("metric").endswith(".rmse") | F.col("metric").endswith(".mae")
    return out.select("metric", F.when(money, F.round("value", 2)).otherwise(F.round("value", 6)).alias("value"))


@query("result_status_tags", with_(*DECISION) + "SELECT 'validation.' || group_id || '.' || model_name || '.status' AS tag, evaluation AS value FROM evaluated UNION ALL SELECT 'selection.' || group_id || '.status', status FROM picked")
def _(spark, sf):
    run = supplier_run(spark, sf)
    return results.status_tags(run.evaluated, run.selection)


_RUN_PARAMS = {"date_column": "l_shipdate", "target_column": "revenue", "key_columns": "l_suppkey", "feature_columns": "(none)", "mode": "Multi Series", "aggregation_method": "sum", "forecast_horizon": "12", "dataset_frequency": "Monthly", "selected_models": "trend_seasonal,autoregressive"}


@query("result_run_parameters", with_(*DECISION) + " UNION ALL ".join(f"SELECT '{k}' AS parameter, '{v}' AS value" for k, v in _RUN_PARAMS.items())
       + " UNION ALL SELECT 'forecast_group_count', CAST(count(*) AS VARCHAR) FROM picked UNION ALL SELECT 'fallback_triggered_groups', CAST(count(*) FILTER (fallback_used) AS VARCHAR) FROM picked")
def _(spark, sf):
    return results.run_parameters(supplier_run(spark, sf).selection, SUPPLIER_ROLES, "Monthly", CLOSED_FORM)


@query("result_flat_parameters", with_(*DECISION, _PARAMS) + "SELECT * FROM (SELECT 'hp.' || group_id || '.autoregressive.p' AS parameter, p AS value FROM params UNION ALL SELECT 'hp.' || group_id || '.autoregressive.d', d FROM params)")
def _(spark, sf):
    return results.flat_parameters(order_params(spark, sf))


@query("result_storage_summary", with_(*DECISION) + "SELECT count(*) AS winners, count(*) FILTER (NOT fallback_used) AS saved FROM picked")
def _(spark, sf):
    return results.storage_summary(supplier_run(spark, sf).selection.withColumn("persisted", ~F.col("fallback_used")))


@query("result_json_mirror", with_(*DECISION) + "SELECT 'run-1' AS run_id, group_id, model_name FROM picked")
def _(spark, sf):
    chosen = supplier_run(spark, sf).selection.select(F.lit("run-1").alias("run_id"), "group_id", "model_name")
    paths = tables.write_mirror(chosen, chosen.where("false"), folder(spark, "mirror"))
    return spark.read.schema("group_id string, model_name string, run_id string").json(paths[0]).select("run_id", "group_id", "model_name")


# -- runs and stages: every user's events read as one run's stage reports ----------------------

_NAMES = [s for s, _ in STAGES[:-10]] + list(OLD_STAGE_NAMES)


def stage_events(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    names = F.array(*[F.lit(n) for n in _NAMES])
    at = F.least(F.floor("value"), F.lit(len(_NAMES) - 1)).cast("int") + 1
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "click", "Running").otherwise("Completed")
    return ev.select(
        F.col("user_id").cast("string").alias("run_id"), F.element_at(names, at).alias("name"), status.alias("status"), F.col("ts").alias("reported_at"), "event_id",
        F.col("ts").alias("started_at"), F.when(status == "Completed", F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts"))).alias("completed_at"),
    )


_PHASES = ", ".join(f"('{s}', '{p}')" for s, p in STAGES)
_OLD = ", ".join(f"('{a}', '{b}')" for a, b in OLD_STAGE_NAMES.items())
_STAGES = f"""names(i, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES))}), oldnames(old, cur) AS (VALUES {_OLD}), phases(stage, phase) AS (VALUES {_PHASES}),
reported AS (SELECT CAST(user_id AS VARCHAR) AS run_id, coalesce(cur, name) AS stage, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Running' ELSE 'Completed' END AS status, ts, event_id,
    CASE WHEN event_type NOT IN ('error', 'click') THEN ts + to_seconds(floor(value)) END AS done FROM events JOIN names ON i = least(floor(value), {len(_NAMES) - 1}) LEFT JOIN oldnames ON old = name),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) AS rk FROM reported) WHERE rk = 1),
sized AS (SELECT phase, count(*) AS whole FROM phases GROUP BY 1),
seen AS (SELECT run_id, phase, count(*) AS members, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Completed') AS completed, min(ts) AS started_at, max(done) AS ended FROM latest JOIN phases USING (stage) GROUP BY 1, 2),
board AS (SELECT r.run_id, z.phase, CASE WHEN members IS NULL THEN 'Pending' WHEN failed > 0 THEN 'Failed' WHEN members = whole AND completed = members THEN 'Completed' ELSE 'Running' END AS status, started_at, ended
    FROM (SELECT DISTINCT run_id FROM reported) r CROSS JOIN sized z LEFT JOIN seen s ON s.run_id = r.run_id AND s.phase = z.phase)"""


@query("runs_phase_statuses", with_(_STAGES) + "SELECT run_id, phase, status, started_at, CASE WHEN status = 'Completed' THEN ended END AS completed_at FROM board")
def _(spark, sf):
    return results.phase_statuses(stage_events(spark, sf))


@query("runs_stage_names", with_(_STAGES) + "SELECT stage, count(*) AS reports FROM reported GROUP BY 1")
def _(spark, sf):
    return stage_events(spark, sf).groupBy(results.current_stage_name(F.col("name")).alias("stage")).agg(F.count(F.lit(1)).alias("reports"))


@query("runs_progress", with_(_STAGES) + "SELECT run_id, count(*) FILTER (status = 'Completed') AS completed_stages, CAST(round(count(*) FILTER (status = 'Completed') / 17.0 * 100) AS BIGINT) AS progress FROM latest JOIN phases USING (stage) GROUP BY 1")
def _(spark, sf):
    return results.run_progress(stage_events(spark, sf))


def run_states(spark, sf) -> DataFrame:
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "FINISHED", "view", "FINISHED", "purchase", "KILLED", "error", "FAILED", "signup", "RUNNING")]), F.col("last"))
    per = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    known = F.when(F.col("last").isin("click", "view", "purchase", "error", "signup"), state)
    return per.select("run_id", "started_at", "ended_at", known.alias("state"))


_RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS started_at, max(ts) AS ended_at, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1),
listed AS (SELECT run_id, started_at, CASE WHEN last IN ('click', 'view') THEN 'Completed' WHEN last = 'purchase' THEN 'Cancelled' ELSE 'Failed' END AS status, greatest(date_diff('microsecond', started_at, ended_at) / 1e6, 0) AS duration_seconds FROM runs)"""


@query("runs_listing", with_(_RUNS) + "SELECT run_id, started_at, status, round(duration_seconds, 3) AS duration_seconds FROM listed")
def _(spark, sf):
    return tables.run_listing(run_states(spark, sf), None).withColumn("duration_seconds", F.round("duration_seconds", 3))


@query("runs_tiles", with_(_RUNS) + """SELECT count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Running') AS running, count(*) FILTER (status = 'Failed') AS failed,
    count(*) FILTER (status = 'Cancelled') AS cancelled FROM listed""")
def _(spark, sf):
    return results.run_tiles(tables.run_listing(run_states(spark, sf), None))


# -- call telemetry: conversation turns read as insight attempts --------------------------------

PRICES = {"simple": (0.0004, 0.0016)}


def calls(spark, sf) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    conv = table(spark, sf, "conversations")
    size = F.length("text")
    raw = conv.select(
        F.concat(F.lit("run-"), F.floor(F.col("conv_id") / 20).cast("string")).alias("run_id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("group_id"),
        F.row_number().over(w).alias("attempt_number"), F.when(F.floor(F.col("conv_id") / 20) < 4, "v1").otherwise("v2").alias("prompt_version"),
        F.when(F.col("conv_id") >= 100, F.when(size > 400, "complex").otherwise("simple")).otherwise("simple").alias("routing_tier"),
        F.floor(size / 4).cast("long").alias("prompt_tokens"), F.floor(size / 10).cast("long").alias("completion_tokens"), (F.floor(size / 4) + F.floor(size / 10)).cast("long").alias("total_tokens"),
        (size * 1.5).alias("latency_ms"), F.when(F.contains("text", F.lit(",")), "passed").otherwise("failed").alias("validation_status"),
        F.when(F.rlike("text", F.lit("[0-9]")), "ungrounded").otherwise("grounded").alias("grounding_status"),
        F.when(F.col("role") == "assistant", "success").otherwise("retry").alias("final_status"), F.when(F.col("role") == "system", "template").otherwise("azure_openai").alias("provider"),
    )
    return telemetry.call_cost(raw, PRICES)


_CALLS = """calls AS (SELECT *, CASE WHEN routing_tier = 'simple' THEN prompt_tokens / 1000.0 * 0.0004 + completion_tokens / 1000.0 * 0.0016 END AS cost FROM (
    SELECT 'run-' || (conv_id // 20) AS run_id, 'conv-' || conv_id AS group_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt_number, CASE WHEN conv_id // 20 < 4 THEN 'v1' ELSE 'v2' END AS prompt_version,
    CASE WHEN conv_id >= 100 AND length(text) > 400 THEN 'complex' ELSE 'simple' END AS routing_tier, length(text) // 4 AS prompt_tokens, length(text) // 10 AS completion_tokens, length(text) // 4 + length(text) // 10 AS total_tokens,
    length(text) * CAST(1.5 AS DOUBLE) AS latency_ms, CASE WHEN contains(text, ',') THEN 'passed' ELSE 'failed' END AS validation_status, CASE WHEN regexp_matches(text, '[0-9]') THEN 'ungrounded' ELSE 'grounded' END AS grounding_status,
    CASE role WHEN 'assistant' THEN 'success' ELSE 'retry' END AS final_status, CASE role WHEN 'system' THEN 'template' ELSE 'azure_openai' END AS provider FROM conversations)),
sums AS (SELECT run_id, count(*) AS call_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(latency_ms), 1) AS average_latency_ms,
    CASE WHEN count(cost) = count(*) FILTER (total_tokens > 0) AND count(cost) > 0 THEN round(sum(cost), 6) END AS cost, count(*) FILTER (attempt_number > 1) AS retry_count,
    round(count(*) FILTER (grounding_status = 'grounded') * 1.0 / count(*), 4) AS groundedness_rate, max(prompt_version) AS prompt_version FROM calls GROUP BY 1),
finals AS (SELECT *, count(*) OVER (PARTITION BY run_id, group_id) AS attempts, row_number() OVER (PARTITION BY run_id, group_id ORDER BY attempt_number DESC) AS rk FROM calls)"""


@query("telemetry_call_costs", with_(_CALLS) + "SELECT group_id, attempt_number, round(cost, 8) AS cost FROM calls")
def _(spark, sf):
    return calls(spark, sf).select("group_id", *long("attempt_number"), F.round("cost", 8).alias("cost"))


@query("telemetry_run_summary", with_(_CALLS) + "SELECT * EXCLUDE (prompt_version) FROM sums")
def _(spark, sf):
    return telemetry.run_summaries(calls(spark, sf))


@query("telemetry_status_histogram", with_(_CALLS) + "SELECT run_id, final_status, count(*) AS calls FROM calls GROUP BY 1, 2")
def _(spark, sf):
    return telemetry.status_histogram(calls(spark, sf))


@query("telemetry_group_calls", with_(_CALLS) + "SELECT run_id, group_id, provider, total_tokens, final_status, attempts, attempts - 1 AS retry_count FROM finals WHERE rk = 1")
def _(spark, sf):
    return telemetry.group_calls(calls(spark, sf)).select("run_id", "group_id", "provider", "total_tokens", "final_status", "attempts", "retry_count")


@query("telemetry_nested_attempts", with_(_CALLS) + "SELECT group_id, string_agg(final_status, '>' ORDER BY attempt_number) AS trail FROM calls GROUP BY 1")
def _(spark, sf):
    out = telemetry.attempts_json(calls(spark, sf))
    return out.select("group_id", F.array_join(F.transform("attempts", lambda a: a["final_status"]), ">").alias("trail"))


@query("telemetry_usage_by_version", with_(_CALLS) + """SELECT u.*, groundedness_rate, validation_pass_rate, retry_rate, fallback_rate FROM (SELECT prompt_version, count(*) AS runs_included, CAST(sum(call_count) AS BIGINT) AS call_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    round(sum(average_latency_ms * call_count) / sum(call_count), 1) AS average_latency_ms, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 6) END AS cost FROM sums GROUP BY 1) u JOIN (
    SELECT s.prompt_version, round(count(*) FILTER (grounding_status = 'grounded') * 1.0 / count(*), 4) AS groundedness_rate, round(count(*) FILTER (validation_status = 'passed') * 1.0 / count(*), 4) AS validation_pass_rate,
    round(count(*) FILTER (attempts > 1) * 1.0 / count(*), 4) AS retry_rate, round(count(*) FILTER (provider <> 'azure_openai') * 1.0 / count(*), 4) AS fallback_rate FROM finals f JOIN sums s USING (run_id) WHERE rk = 1 GROUP BY 1) q USING (prompt_version)""")
def _(spark, sf):
    return telemetry.usage_by_version(calls(spark, sf))


@query("telemetry_token_budget", with_(_CALLS) + """SELECT run_id, group_id, tokens_before, 5000 - tokens_before < 200 AS skipped FROM (SELECT run_id, group_id, CAST(coalesce(sum(tokens) OVER (PARTITION BY run_id ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before
    FROM (SELECT run_id, group_id, sum(total_tokens) AS tokens FROM calls GROUP BY 1, 2))""")
def _(spark, sf):
    return telemetry.over_budget(calls(spark, sf), 5000).select("run_id", "group_id", *long("tokens_before"), "skipped")


@query("telemetry_routing_tier", with_(_CALLS) + "SELECT group_id, CASE WHEN count(*) > 1 THEN 'complex' ELSE 'simple' END AS tier FROM calls GROUP BY 1")
def _(spark, sf):
    return calls(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select("group_id", telemetry.routing_tier(F.col("n")).alias("tier"))


# -- workload ----------------------------------------------------------------------------------

_DEPTH = "depth AS (SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS periods FROM orders GROUP BY 1)"
_WORK = """work AS (SELECT count(*) AS groups, CAST(4 AS BIGINT) AS models_per_group, count(*) * 4 AS evaluations, CAST(sum(f) * 4 AS BIGINT) AS folds, CAST(sum(f) AS BIGINT) AS folds_per_model,
    CAST(sum(CASE WHEN periods >= 24 THEN 4 WHEN periods >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS eligible_pairs, CAST(sum(CASE WHEN periods >= 48 THEN 4 ELSE 0 END) AS BIGINT) AS tuning_pairs, count(*) AS insight_calls
    FROM (SELECT *, CASE WHEN periods >= 15 THEN least(5, (periods - 15) // 3 + 1) ELSE 0 END AS f FROM depth))"""


def depth(spark, sf) -> DataFrame:
    return customer_sizes(spark, sf).select("group_id", F.col("n").alias("periods"))


@query("workload_fold_counts", with_(_DEPTH) + "SELECT CAST(o_custkey AS VARCHAR) AS group_id, CASE WHEN periods >= 15 THEN least(5, (periods - 15) // 3 + 1) ELSE 0 END AS folds FROM depth")
def _(spark, sf):
    return depth(spark, sf).select("group_id", workload.depth_folds(F.col("periods")).alias("folds"))


@query("workload_counts", with_(_DEPTH, _WORK) + "SELECT * FROM work")
def _(spark, sf):
    return workload.workload(depth(spark, sf))


def run_history(spark, sf) -> DataFrame:
    per = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(
        F.min("ts").alias("started_at"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("value").alias("v"), F.max("value").alias("top"))
    return per.select(
        "run_id", "started_at", F.lit("Completed").alias("status"), (F.col("v") + F.col("top")).alias("duration_seconds"), F.col("v").alias("stage_seconds"), F.col("v").alias("backtest_seconds"), F.col("k").alias("folds"),
        F.col("top").alias("train_seconds"), F.col("k").alias("trained"), F.col("top").alias("importance_seconds"), F.col("k").alias("survivors"), (F.col("top") * 1000).alias("latency_ms"))


_HISTORY = """hist AS (SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS started_at, CAST(count(*) AS DOUBLE) AS k, sum(value) AS v, max(value) AS top FROM events GROUP BY 1),
recent AS (SELECT * FROM hist),
cal AS (SELECT count(*) AS runs_used, (SELECT median(f) FROM (SELECT v / k AS f FROM recent UNION ALL SELECT top / k FROM recent)) AS seconds_per_fit, median(top / k) AS seconds_per_importance, median(top) AS seconds_per_call, median(top) AS startup_seconds FROM recent)"""


@query("workload_calibration", with_(_HISTORY) + f"SELECT runs_used, {r_(6, 'seconds_per_fit', 'seconds_per_importance', 'seconds_per_call', 'startup_seconds')} FROM cal")
def _(spark, sf):
    return workload.calibration(run_history(spark, sf)).select("runs_used", *rounded(6, "seconds_per_fit", "seconds_per_importance", "seconds_per_call", "startup_seconds"))


_TIME = "estimate AS (SELECT *, 20 + (groups + folds_per_model) * seconds_per_fit * ((1.6 + 0.9 + 0.35 + 0.3) / 0.75) + eligible_pairs * seconds_per_importance + insight_calls * seconds_per_call AS seconds FROM work, cal)"


@query("workload_runtime", with_(_DEPTH, _WORK, _HISTORY, _TIME) + "SELECT round(seconds, 4) AS seconds, round(seconds * 0.7, 4) AS low_seconds, round(seconds * 1.6, 4) AS high_seconds FROM estimate")
def _(spark, sf):
    out = workload.runtime(workload.workload(depth(spark, sf)), workload.calibration(run_history(spark, sf)))
    return out.select(*rounded(4, "seconds", "low_seconds", "high_seconds"))


@query("workload_cost", with_(_DEPTH, _WORK, _HISTORY, _TIME) + """SELECT compute_low, compute_high, token_low, token_high, round(compute_low + token_low, 2) AS total_low, round(compute_high + token_high, 2) AS total_high FROM (
    SELECT round(seconds * 0.7 / 3600.0 * 3.5, 2) AS compute_low, round(seconds * 1.6 / 3600.0 * 3.5, 2) AS compute_high, round(insight_calls * (1.1 * 0.0004 + 0.11 * 0.0016) * 0.7, 4) AS token_low, round(insight_calls * (1.1 * 0.0004 + 0.11 * 0.0016) * 1.6, 4) AS token_high FROM estimate)""")
def _(spark, sf):
    out = workload.runtime(workload.workload(depth(spark, sf)), workload.calibration(run_history(spark, sf)))
    return workload.cost(out, 3.5, 0.0004, 0.0016).select("compute_low", "compute_high", "token_low", "token_high", "total_low", "total_high")
