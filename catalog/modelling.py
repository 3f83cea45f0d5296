"""Models, folds, metrics, windows and plausibility rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import AUTO, FRAME, NAIVE, PREDICTIONS, SERIES, TREND, once, supplier_run, supplier_series, with_
from keycast.config import MODELS, Backtest, Roles, resolve_models
from keycast.functions.skew import stable
from keycast.operators import clean, folds, metrics, rules, training
from keycast.operators import series as series_ops
from keycast.operators.models import autoregressive, naive, trend


def long(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


def rounded(digits, *names):
    return [F.round(c, digits).alias(c) for c in names]


def r_(digits, *names):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def frame_of(spark, sf):
    return folds.frame(supplier_series(spark, sf))


@query("folds_bounds", with_(FRAME) + "SELECT group_id, CAST(fold AS BIGINT) AS fold, CAST(train_start AS BIGINT) AS train_start, CAST(train_end AS BIGINT) AS train_end FROM folds")
def _(spark, sf):
    facts = supplier_series(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return folds.fold_table(facts).select("group_id", *long("fold", "train_start", "train_end"))


@query("folds_expanding", with_(SERIES) + """SELECT group_id, CAST(k AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(n - 3 - 3 * (4 - k) AS BIGINT) AS train_end
    FROM (SELECT DISTINCT group_id, n FROM series), range(5) r(k) WHERE n >= 27""")
def _(spark, sf):
    facts = supplier_series(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n >= 27")
    return folds.fold_table(facts, Backtest(strategy="expanding", newest_first=True)).select("group_id", *long("fold", "train_start", "train_end"))


@query("folds_all", with_(SERIES) + """SELECT group_id, CAST(k AS BIGINT) AS fold, CAST(3 * k AS BIGINT) AS train_start, CAST(12 + 3 * k AS BIGINT) AS train_end
    FROM (SELECT DISTINCT group_id, n FROM series), range(1000) r(k) WHERE n >= 15 + 3 * k""")
def _(spark, sf):
    facts = supplier_series(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return folds.fold_table(facts, Backtest(max_folds=None)).select("group_id", *long("fold", "train_start", "train_end"))


@query("backtest_all_folds", with_(FRAME.replace("range(5) r(k)", "range(1000) r(k)"), TREND) + f"""SELECT group_id, count(DISTINCT fold) AS folds, {r_(6, 'wmape')}, {r_(2, 'mae')} FROM (
    SELECT group_id, fold, sum(abs(actual - value)) OVER (PARTITION BY group_id) / nullif(sum(abs(actual)) OVER (PARTITION BY group_id), 0) * 100 AS wmape, avg(abs(actual - value)) OVER (PARTITION BY group_id) AS mae FROM trend WHERE fold >= 0) GROUP BY group_id, wmape, mae""")
def _(spark, sf):
    """Every fold of a series judges it, the newest months too."""
    frame = folds.frame(supplier_series(spark, sf), Backtest(max_folds=None))
    return metrics.overall(trend.predict(frame)).select("group_id", *long("folds"), *rounded(6, "wmape"), *rounded(2, "mae"))


@query("folds_frame", with_(FRAME) + "SELECT group_id, CAST(fold AS BIGINT) AS fold, part, CAST(step AS BIGINT) AS step, CAST(t AS BIGINT) AS t, ds, round(y, 4) AS y FROM frame")
def _(spark, sf):
    return frame_of(spark, sf).select("group_id", *long("fold"), "part", *long("step", "t"), "ds", F.round("y", 4).alias("y"))


_OUT = ["value", "lower", "upper"]


@query("model_seasonal_naive", with_(FRAME, NAIVE) + "SELECT group_id, model_name, CAST(fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, ds, round(actual, 4) AS actual, round(value, 4) AS value FROM naive")
def _(spark, sf):
    return naive.predict(frame_of(spark, sf)).select("group_id", "model_name", *long("fold", "step"), "ds", *rounded(4, "actual", "value"))


@query("model_trend_seasonal", with_(FRAME, TREND) + f"SELECT group_id, model_name, CAST(fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, ds, {r_(2, *_OUT)} FROM trend")
def _(spark, sf):
    return trend.predict(frame_of(spark, sf)).select("group_id", "model_name", *long("fold", "step"), "ds", *rounded(2, *_OUT))


@query("model_autoregressive", with_(FRAME, AUTO) + f"SELECT group_id, model_name, CAST(fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, ds, {r_(2, *_OUT)} FROM auto")
def _(spark, sf):
    return autoregressive.predict(frame_of(spark, sf)).select("group_id", "model_name", *long("fold", "step"), "ds", *rounded(2, *_OUT))


@query("model_autoregressive_orders", with_(FRAME, AUTO) + "SELECT group_id, CAST(fold AS BIGINT) AS fold, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, round(aic, 4) AS aic, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM ar_fit")
def _(spark, sf):
    return autoregressive.fits(frame_of(spark, sf)).select("group_id", *long("fold", "p", "d"), F.round("aic", 4).alias("aic"), *rounded(6, "c1", "c2", "c3"))


_NEED = {m.name: m.min_rows for m in MODELS if m.candidate}
_REGISTRY = "registry(model_name, pos, need) AS (VALUES " + ", ".join(f"('{m}', {i}, {n})" for i, (m, n) in enumerate(_NEED.items())) + ")"
_SIZES = "sizes AS (SELECT CAST(o_custkey AS VARCHAR) AS group_id, count(DISTINCT date_trunc('month', o_orderdate)) AS n FROM orders GROUP BY 1)"
_STATUS = "status AS (SELECT group_id, model_name, pos, CASE WHEN n < need THEN 'Skipped' ELSE 'Trained' END AS status FROM sizes, registry)"


def customer_sizes(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    months = orders.select(F.col("o_custkey").cast("string").alias("group_id"), F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    return months.groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("training_eligibility", with_(_REGISTRY, _SIZES, _STATUS) + "SELECT group_id, model_name, CAST(pos AS BIGINT) AS model_position, status FROM status")
def _(spark, sf):
    return training.eligibility(customer_sizes(spark, sf)).select("group_id", "model_name", *long("model_position"), "status")


@query("training_unavailable_model", with_(_REGISTRY, _SIZES, _STATUS) + """SELECT CASE WHEN model_name = 'random_forest' THEN 'Unavailable' ELSE status END AS status, count(*) AS pairs FROM status GROUP BY 1""")
def _(spark, sf):
    return training.status_counts(training.eligibility(customer_sizes(spark, sf), unavailable={"random_forest"}))


@query("training_selected_models", with_(_REGISTRY, _SIZES, _STATUS) + "SELECT model_name, status, count(*) AS pairs FROM status WHERE model_name IN ('autoregressive', 'boosted_trees') GROUP BY 1, 2")
def _(spark, sf):
    pairs = training.eligibility(customer_sizes(spark, sf), resolve_models(["autoregressive", "boosted_trees"]))
    return pairs.groupBy("model_name", "status").agg(F.count(F.lit(1)).alias("pairs"))


@query("training_report", with_(_REGISTRY, _SIZES, _STATUS) + """SELECT count(DISTINCT group_id) AS groups, count(*) AS pairs, count(*) FILTER (status = 'Trained') AS trained,
    count(*) FILTER (status = 'Skipped') AS skipped, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS unavailable FROM status""")
def _(spark, sf):
    return training.training_report(training.eligibility(customer_sizes(spark, sf)))


# -- backtest metrics ---------------------------------------------------------------

METRIC_SQL = """avg(CASE WHEN actual <> 0 THEN abs(actual - value) / abs(actual) END) * 100 AS mape, sum(abs(actual - value)) / nullif(sum(abs(actual)), 0) * 100 AS wmape,
    sqrt(avg((actual - value) * (actual - value))) AS rmse, avg(abs(actual - value)) AS mae,
    avg(coalesce(abs(actual - value) / nullif((abs(actual) + abs(value)) / 2, 0), 0)) * 100 AS smape,
    greatest(0, 100 - sum(abs(actual - value)) / nullif(sum(abs(actual)), 0) * 100) AS accuracy, count(*) AS observations"""
SCORES = f"scores AS (SELECT group_id, model_name, {METRIC_SQL}, count(DISTINCT fold) AS folds FROM predictions WHERE fold >= 0 GROUP BY 1, 2)"
_PCT = ("mape", "wmape", "smape", "accuracy")


@query("backtest_predictions", with_(PREDICTIONS) + "SELECT group_id, model_name, CAST(fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, round(actual, 4) AS actual, round(value, 2) AS value FROM predictions WHERE fold >= 0")
def _(spark, sf):
    rows = supplier_run(spark, sf).predictions.where("fold >= 0")
    return rows.select("group_id", "model_name", *long("fold", "step"), F.round("actual", 4).alias("actual"), F.round("value", 2).alias("value"))


@query("backtest_overall", with_(PREDICTIONS, SCORES) + f"SELECT group_id, model_name, {r_(6, *_PCT)}, {r_(2, 'rmse', 'mae')}, observations, folds FROM scores")
def _(spark, sf):
    return metrics.overall(supplier_run(spark, sf).predictions).select("group_id", "model_name", *rounded(6, *_PCT), *rounded(2, "rmse", "mae"), "observations", *long("folds"))


@query("backtest_views", with_(PREDICTIONS, f"""views AS (SELECT group_id, model_name, fold, step, CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(step) = 0 THEN 'step' ELSE 'overall' END AS view,
    {METRIC_SQL} FROM predictions WHERE fold >= 0 GROUP BY GROUPING SETS ((group_id, model_name), (group_id, model_name, fold), (group_id, model_name, step)))""")
    + f"SELECT group_id, model_name, CAST(fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, view, {r_(6, *_PCT)}, {r_(2, 'rmse', 'mae')}, observations FROM views")
def _(spark, sf):
    out = metrics.backtest_views(supplier_run(spark, sf).predictions)
    return out.select("group_id", "model_name", *long("fold", "step"), "view", *rounded(6, *_PCT), *rounded(2, "rmse", "mae"), "observations")


# One metric at a time on raw rows: events as (actual, value) pairs of neighbouring readings, zeros included.
_PAIRS = """pairs AS (SELECT event_type AS group_id, floor(value) AS actual, lag(floor(value)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS value FROM events)"""


def event_pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    whole = F.floor("value").cast("double")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select(F.col("event_type").alias("group_id"), whole.alias("actual"), F.lag(whole).over(w).alias("value"))


@query("metrics_with_zero_actuals", with_(_PAIRS) + f"SELECT group_id, {r_(6, 'mape', 'wmape', 'rmse', 'mae', 'smape', 'accuracy')}, observations FROM (SELECT group_id, {METRIC_SQL} FROM pairs WHERE value IS NOT NULL GROUP BY 1)")
def _(spark, sf):
    pairs = event_pairs(spark, sf).where(metrics.finite(F.col("actual")) & metrics.finite(F.col("value")))
    return pairs.groupBy("group_id").agg(*metrics.metric_columns()).select("group_id", *rounded(6, "mape", "wmape", "rmse", "mae", "smape", "accuracy"), "observations")


@query("backtest_skip_reasons", with_(_SIZES, "need AS (SELECT group_id, n FROM sizes WHERE n >= 2)") + """SELECT CASE WHEN n < 15 THEN 'too few observations to backtest' ELSE 'no fold could be evaluated' END AS skipped_reason,
    count(*) AS pairs FROM need GROUP BY 1""")
def _(spark, sf):
    pairs = training.eligibility(customer_sizes(spark, sf), tuple(m for m in MODELS if m.name == "seasonal_naive"))
    none = metrics.overall(supplier_run(spark, sf).predictions.where("fold >= 0 AND model_name = 'seasonal_naive'"))
    status = metrics.backtest_status(pairs, none)
    return status.groupBy("skipped_reason").agg(F.count(F.lit(1)).alias("pairs"))


@query("forward_forecasts", with_(PREDICTIONS) + f"SELECT group_id, model_name, CAST(step AS BIGINT) AS step, ds, {r_(2, *_OUT)} FROM predictions WHERE fold = -1")
def _(spark, sf):
    return supplier_run(spark, sf).forecasts.select("group_id", "model_name", *long("step"), "ds", *rounded(2, *_OUT))


# -- reference window and rules --------------------------------------------------------


@query("window_season_length", """SELECT o_orderpriority AS grain_source, CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 52 WHEN '3-MEDIUM' THEN 12 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 12 END AS season,
    CAST(greatest(0, least(count(*), greatest(2 * CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 52 WHEN '3-MEDIUM' THEN 12 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 12 END, 36, 12))) AS BIGINT) AS window_rows
    FROM orders GROUP BY 1""")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    grains = {"1-URGENT": "Daily", "2-HIGH": "Weekly", "3-MEDIUM": "Monthly", "4-NOT SPECIFIED": "Quarterly", "5-LOW": "Irregular"}
    from keycast.functions.skew import small_map

    counted = orders.groupBy(F.col("o_orderpriority").alias("grain_source")).agg(F.count(F.lit(1)).alias("n"))
    grain = F.element_at(small_map(grains), F.col("grain_source"))
    return counted.select("grain_source", rules.season_length_of(grain).alias("season"), rules.window_length(F.col("n"), grain, 12).cast("long").alias("window_rows"))


@query("window_rows", with_(SERIES) + "SELECT group_id, ds, round(y, 4) AS y FROM series WHERE t >= n - least(n, 36)")
def _(spark, sf):
    return rules.reference_window(supplier_series(spark, sf), "Monthly", 12).select("group_id", "ds", F.round("y", 4).alias("y"))


HISTORY = """inside AS (SELECT *, CASE WHEN t >= n - least(n, 36) THEN y END AS wy FROM series),
centred AS (SELECT *, wy - avg(wy) OVER (PARTITION BY group_id) AS c FROM inside),
lagged12 AS (SELECT *, lag(c, 12) OVER (PARTITION BY group_id ORDER BY t) AS c12 FROM centred),
past AS (SELECT group_id, count(*) AS n, count(wy) AS window_n, stddev_pop(wy) AS window_std, avg(wy) AS window_mean,
    quantile_cont(wy, 0.01) AS p1, quantile_cont(wy, 0.25) AS q1, quantile_cont(wy, 0.75) AS q3, quantile_cont(wy, 0.99) AS p99,
    avg(CASE WHEN t >= n - 12 THEN y END) AS recent_mean, max(CASE WHEN t >= n - 12 THEN wy END) - min(CASE WHEN t >= n - 12 THEN wy END) AS cycle_range,
    sum(c * c12) / nullif(sum(c * c), 0) AS acf, regr_slope(y, t) AS slope, avg(y) AS mean FROM lagged12 GROUP BY 1)"""


@query("window_history_facts", with_(SERIES, HISTORY) + f"SELECT group_id, n, window_n, {r_(2, 'window_std', 'window_mean', 'p1', 'q1', 'q3', 'p99', 'recent_mean', 'mean')}, round(cycle_range, 4) AS cycle_range, {r_(4, 'slope')}, {r_(6, 'acf')} FROM past")
def _(spark, sf):
    out = rules.history_facts(supplier_series(spark, sf), "Monthly", 12)
    for i, c in enumerate(("p1", "q1", "q3", "p99"), 1):
        out = out.withColumn(c, F.element_at("corners", i))
    return out.select("group_id", "n", "window_n", *rounded(2, "window_std", "window_mean", "p1", "q1", "q3", "p99", "recent_mean", "mean"), *rounded(4, "cycle_range", "slope"), *rounded(6, "acf"))


JUDGED = """ahead AS (SELECT f.*, p.* EXCLUDE (group_id), p1 - (p99 - p1) * 0.25 AS slow, p99 + (p99 - p1) * 0.25 AS shigh, q1 - 3 * (q3 - q1) AS ilow, q3 + 3 * (q3 - q1) AS ihigh, q3 - q1 AS iqr
    FROM predictions f JOIN past p USING (group_id) WHERE f.fold = -1),
judged AS (SELECT group_id, model_name, any_value(n) AS n, any_value(window_n) AS window_n, any_value(acf) AS acf, any_value(iqr) AS iqr, count(*) AS steps,
    count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS non_finite, count(*) FILTER (value < slow OR value > shigh) AS spikes, count(*) FILTER (value < ilow OR value > ihigh) AS iqr_breaches,
    stddev_pop(value) / nullif(any_value(window_std), 0) AS volatility, abs(avg(value) / nullif(any_value(recent_mean), 0)) AS growth,
    stddev_pop(value) / abs(avg(value)) / nullif(any_value(window_std) / abs(any_value(window_mean)), 0) AS variance,
    (max(value) - min(value)) / nullif(any_value(cycle_range), 0) AS season, abs(any_value(slope)) / abs(any_value(mean)) AS h_trend,
    abs(regr_slope(value, step)) / abs(avg(value)) / nullif(abs(any_value(slope)) / abs(any_value(mean)), 0) AS kept FROM ahead GROUP BY 1, 2)"""
_RULES = {
    "non_finite_forecast": ("non_finite > 0", "CAST(non_finite AS DOUBLE)", "Non-Finite Forecast Values"),
    "excessive_volatility": ("volatility > 2.5", "volatility", "Excessive Forecast Volatility"),
    "percentile_spike": ("spikes > 0", "CAST(spikes AS DOUBLE)", "Unrealistic Forecast Spikes"),
    "iqr_bounds": ("iqr <> 0 AND iqr_breaches > 0", "CASE WHEN iqr <> 0 THEN CAST(iqr_breaches AS DOUBLE) END", "Historical Bound Violation"),
    "abnormal_growth": ("growth > 1.5 OR growth < 1.0 / 1.5", "growth", "Abnormal Growth Rate"),
    "forecast_variance": ("variance > 3", "variance", "High Forecast Variance"),
    "flat_forecast": ("volatility < 0.05", "volatility", "Flat Or Near-Constant Forecast"),
    "excessive_smoothing": ("volatility < 0.15", "volatility", "Excessive Smoothing"),
    "missing_seasonality": ("window_n >= 24 AND acf >= 0.3 AND season < 0.25", "CASE WHEN window_n >= 24 AND acf >= 0.3 THEN season END", "Missing Seasonality"),
    "missing_trend": ("h_trend >= 0.05 AND kept < 0.1", "CASE WHEN h_trend >= 0.05 THEN kept END", "Missing Trend"),
}
OUTCOMES = "outcomes AS (" + " UNION ALL ".join(
    f"SELECT group_id, model_name, '{rule}' AS rule_id, NOT coalesce({bad}, false) AS passed, CASE WHEN coalesce({bad}, false) THEN '{reason}' END AS reason, {measure} AS measure FROM judged WHERE n >= 12"
    for rule, (bad, measure, reason) in _RULES.items()) + ")"
VERDICTS = """verdicts AS (SELECT j.group_id, j.model_name, coalesce(bool_and(passed), true) AS passed, count(*) FILTER (NOT passed) AS failed_rules,
    coalesce(string_agg(reason, ', ' ORDER BY reason), '') AS reasons FROM judged j LEFT JOIN outcomes o USING (group_id, model_name) GROUP BY 1, 2)"""
RULE_CHAIN = (PREDICTIONS, HISTORY, JUDGED, OUTCOMES)

for _rule in _RULES:
    @query(f"rule_{_rule}", with_(*RULE_CHAIN) + f"SELECT group_id, model_name, passed, reason, round(measure, 6) AS measure FROM outcomes WHERE rule_id = '{_rule}'")
    def _(spark, sf, rule=_rule):
        out = supplier_run(spark, sf).rules.where(F.col("rule_id") == rule)
        return out.select("group_id", "model_name", "passed", "reason", F.round("measure", 6).alias("measure"))


@query("rules_verdict", with_(*RULE_CHAIN, VERDICTS) + "SELECT * FROM verdicts")
def _(spark, sf):
    return supplier_run(spark, sf).verdicts.select("group_id", "model_name", "passed", "failed_rules", F.array_join("reasons", ", ").alias("reasons"))


EVALUATED = """evaluated AS (SELECT v.group_id, v.model_name, CASE v.model_name WHEN 'trend_seasonal' THEN 0 ELSE 1 END AS pos,
    CASE WHEN passed THEN 'Survived' ELSE 'Eliminated' END AS evaluation, reasons, s.* EXCLUDE (group_id, model_name) FROM verdicts v LEFT JOIN scores s USING (group_id, model_name))"""
EVALUATION_CHAIN = (*RULE_CHAIN, VERDICTS, SCORES, EVALUATED)


@query("rules_survivors", with_(*EVALUATION_CHAIN) + "SELECT group_id, model_name FROM evaluated WHERE evaluation = 'Survived'")
def _(spark, sf):
    return rules.survivors(supplier_run(spark, sf).evaluated).select("group_id", "model_name")


@query("evaluation_report", with_(*EVALUATION_CHAIN) + """SELECT count(*) FILTER (evaluation = 'Survived') AS survived, count(*) FILTER (evaluation = 'Eliminated') AS eliminated,
    CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(sum(folds) AS BIGINT) AS folds_evaluated FROM evaluated""")
def _(spark, sf):
    return rules.evaluation_report(supplier_run(spark, sf).evaluated)


# -- trend with a regressor: the mean discount of each supplier's month, on folds of whole years ------

_DISCOUNT_FOLDS = Backtest(strategy="expanding", min_train=36, horizon=3, max_folds=3)


def discount_series(spark, sf):
    def build():
        roles = Roles("l_shipdate", "revenue", ("l_suppkey",), ("l_discount",))
        rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
        months = clean.to_months(rows, roles).withColumn("revenue", F.round("revenue", 4)).withColumn("l_discount", F.round("l_discount", 8))
        return stable(series_ops.build_series(months, roles))

    return once(spark, f"discounts:{sf}", build)


_JOINT = """months AS (SELECT CAST(l_suppkey AS VARCHAR) AS group_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS y, round(avg(l_discount), 8) AS x FROM lineitem GROUP BY 1, 2),
series AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY group_id) AS n FROM months),
ends AS (SELECT group_id, k AS fold, 36 + 3 * k AS train_end FROM (SELECT DISTINCT group_id, n FROM series), range(3) r(k) WHERE n >= 39 + 3 * k UNION ALL SELECT DISTINCT group_id, -1, n FROM series),
spacing AS (SELECT group_id, max(n) AS n, max(ds) AS last_ds, max_by(x, ds) AS x, median(gap) AS step_days FROM (SELECT *, date_diff('day', lag(ds) OVER (PARTITION BY group_id ORDER BY t), ds) AS gap FROM series) GROUP BY 1),
learnt AS (SELECT s.*, e.fold, month(s.ds) AS m FROM ends e JOIN series s ON s.group_id = e.group_id AND s.t < e.train_end),
tested AS (SELECT s.group_id, e.fold, s.t - e.train_end + 1 AS step, s.t, s.ds, s.x FROM ends e JOIN series s ON s.group_id = e.group_id AND e.fold >= 0 AND s.t >= e.train_end AND s.t < e.train_end + 3
    UNION ALL SELECT group_id, -1, s + 1, n + s, last_ds + CAST(floor(step_days * (s + 1)) AS INTEGER), x FROM spacing, range(12) r(s)),
within AS (SELECT *, y - avg(y) OVER w AS dy, t - avg(t) OVER w AS dt, x - avg(x) OVER w AS dx FROM learnt WINDOW w AS (PARTITION BY group_id, fold, m)),
slopes AS (SELECT group_id, fold, (sum(dx * dx) * sum(dt * dy) - sum(dt * dx) * sum(dx * dy)) / (sum(dt * dt) * sum(dx * dx) - sum(dt * dx) * sum(dt * dx)) AS bt,
    (sum(dt * dt) * sum(dx * dy) - sum(dt * dx) * sum(dt * dy)) / (sum(dt * dt) * sum(dx * dx) - sum(dt * dx) * sum(dt * dx)) AS bx FROM within GROUP BY 1, 2),
means AS (SELECT group_id, fold, m, avg(y) AS my, avg(t) AS mt, avg(x) AS mx FROM learnt GROUP BY 1, 2, 3)"""


@query("model_trend_regressor", with_(_JOINT) + """SELECT t.group_id, CAST(t.fold AS BIGINT) AS fold, CAST(step AS BIGINT) AS step, ds, round(my + bt * (t.t - mt) + bx * (t.x - mx), 1) AS value
    FROM tested t JOIN slopes USING (group_id, fold) JOIN means ON means.group_id = t.group_id AND means.fold = t.fold AND means.m = month(t.ds)""")
def _(spark, sf):
    frame = folds.frame(discount_series(spark, sf), _DISCOUNT_FOLDS, 12, ["l_discount"])
    return trend.predict(frame, ["l_discount"]).select("group_id", *long("fold", "step"), "ds", F.round("value", 1).alias("value"))
