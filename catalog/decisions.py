"""Importance, ranking, drift and production selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import CLOSED_FORM, SERIES, SUPPLIER_ROLES, once, supplier_months, supplier_run, supplier_series, table, with_
from catalog.modelling import EVALUATION_CHAIN, long, r_, rounded
from keycast.config import Drift, Importance, Roles
from keycast.functions import samples as S
from keycast.functions.skew import stable
from keycast.operators import clean, drift, features, importance, ranking, selection
from keycast.operators import series as series_ops
from keycast.plans import forecast

# -- importance vectors: absolute correlation of each feature with the change to predict --

NAMES = ["time_index", "lag_1", "lag_2", "lag_3", "lag_12", "rolling_mean_3", "rolling_mean_6", "month", "quarter"]


def matrix(spark, sf) -> DataFrame:
    return once(spark, f"matrix:{sf}", lambda: stable(features.design_matrix(supplier_series(spark, sf), ["group_id"])))


def correlations(rows: DataFrame, vector_id) -> DataFrame:
    tagged = rows.withColumn("vector_id", vector_id).withColumn("model_name", F.lit("linear")).where(F.col("vector_id").isNotNull())
    found = importance.feature_correlations(tagged, ["group_id", "model_name", "vector_id"], NAMES, "label")
    return found.withColumn("weight", F.coalesce(F.abs("correlation"), F.lit(0.0)))


def vectors(spark, sf) -> dict[str, DataFrame]:
    def build():
        rows = matrix(spark, sf)
        n = F.col("n")
        point = importance.normalised(correlations(rows, F.lit("point")))
        parts = importance.normalised(correlations(rows, F.concat(F.lit("segment_"), importance.segment(F.col("t"), n).cast("string"))))
        half = importance.normalised(correlations(rows.where(importance.in_tail(F.col("t"), n, 0.5)), F.lit("tail")))
        keep = ["group_id", "model_name", "vector_id", "feature", "weight", "correlation"]
        return {k: stable(v.select(*keep)) for k, v in {"point": point, "window": parts, "horizon": half.unionByName(point)}.items()}

    return once(spark, f"vectors:{sf}", build)


_W = "PARTITION BY group_id ORDER BY t"
_MATRIX = f"""derived AS (SELECT *, CAST(t AS DOUBLE) AS time_index, lag(y, 1) OVER ({_W}) AS lag_1, lag(y, 2) OVER ({_W}) AS lag_2, lag(y, 3) OVER ({_W}) AS lag_3,
    lag(y, 12) OVER ({_W}) AS lag_12, avg(y) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3,
    avg(y) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS rolling_mean_6, month(ds) AS month, quarter(ds) AS quarter, y - lag(y) OVER ({_W}) AS label FROM series),
matrix AS (SELECT * FROM derived WHERE t >= 12),
placed AS (SELECT *, 'point' AS vector_id FROM matrix UNION ALL SELECT *, 'segment_' || least(t // (n // 2), 1) FROM matrix WHERE n >= 16
    UNION ALL SELECT *, 'tail' FROM matrix WHERE t >= n - greatest(8, n // 2))"""
_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT group_id, vector_id, '{f}' AS feature, corr({f}, label) AS correlation FROM placed GROUP BY 1, 2" for f in NAMES) + """),
vec AS (SELECT group_id, vector_id, feature, correlation, abs(correlation) / sum(abs(correlation)) OVER (PARTITION BY group_id, vector_id) AS weight FROM raw)"""
_VEC = (SERIES, _MATRIX, _RAW)


@query("importance_segments", with_(SERIES) + "SELECT group_id, CAST(least(t // (n // 2), 1) AS BIGINT) AS segment, count(*) AS row_count FROM series WHERE n >= 16 GROUP BY 1, 2")
def _(spark, sf):
    rows = supplier_series(spark, sf).withColumn("segment", importance.segment(F.col("t"), F.col("n")).cast("long"))
    return rows.where("segment IS NOT NULL").groupBy("group_id", "segment").agg(F.count(F.lit(1)).alias("row_count"))


@query("importance_normalised_vectors", with_(*_VEC) + "SELECT group_id, vector_id, feature, round(weight, 6) AS weight FROM vec")
def _(spark, sf):
    found = vectors(spark, sf)
    both = found["window"].unionByName(found["horizon"])
    return both.select("group_id", "vector_id", "feature", F.round("weight", 6).alias("weight"))


@query("importance_plausibility", with_(*_VEC) + "SELECT group_id, round(sum(CASE WHEN abs(correlation) >= 0.05 THEN weight ELSE 0 END) / sum(weight), 6) AS plausibility FROM vec WHERE vector_id = 'point' GROUP BY 1")
def _(spark, sf):
    point = vectors(spark, sf)["point"]
    found = importance.plausibility(point.drop("correlation"), point.select("group_id", "model_name", "feature", "correlation"))
    return found.select("group_id", F.round("plausibility", 6).alias("plausibility"))


_RANKS = """ranks AS (SELECT *, rank() OVER (PARTITION BY group_id, vector_id ORDER BY weight) + (count(*) OVER (PARTITION BY group_id, vector_id, weight) - 1) / 2.0 AS r FROM vec),
pair AS (SELECT a.group_id, a.vector_id AS va, b.vector_id AS vb, corr(a.r, b.r) AS rho FROM ranks a JOIN ranks b USING (group_id, feature) WHERE a.vector_id < b.vector_id GROUP BY 1, 2, 3),
steady AS (SELECT group_id, greatest(0, least(1, (avg(rho) FILTER (va LIKE 'segment%' AND vb LIKE 'segment%') + 1) / 2)) AS window_stability,
    greatest(0, least(1, (avg(rho) FILTER (va = 'point' AND vb = 'tail') + 1) / 2)) AS horizon_stability, greatest(0, least(1, (avg(rho) + 1) / 2)) AS all_stability FROM pair GROUP BY 1)"""


@query("importance_consistency", with_(*_VEC, _RANKS) + "SELECT group_id, round(window_stability, 6) AS window_stability, round(horizon_stability, 6) AS horizon_stability, round(all_stability, 6) AS all_stability FROM steady")
def _(spark, sf):
    found = vectors(spark, sf)
    out = importance.consistency(found["window"], "window_stability").join(importance.consistency(found["horizon"], "horizon_stability"), ["group_id", "model_name"])
    out = out.join(importance.consistency(found["window"].unionByName(found["horizon"]), "all_stability"), ["group_id", "model_name"])
    return out.select("group_id", *rounded(6, "window_stability", "horizon_stability", "all_stability"))


@query("importance_average_ranks", with_(*_VEC, _RANKS) + "SELECT group_id, vector_id, feature, r FROM ranks")
def _(spark, sf):
    found = vectors(spark, sf)
    both = found["window"].unionByName(found["horizon"])
    return both.select("group_id", "vector_id", "feature", importance.average_rank("weight", ["group_id", "vector_id"]).alias("r"))


_LEAD = """lead AS (SELECT group_id, vector_id, feature, row_number() OVER (PARTITION BY group_id, vector_id ORDER BY weight DESC, feature) AS rk FROM vec),
main AS (SELECT group_id, feature AS dominant_feature FROM lead WHERE vector_id = 'point' AND rk = 1),
agreed AS (SELECT group_id, avg(CASE WHEN feature = dominant_feature THEN 1.0 ELSE 0.0 END) AS dominant_consistency FROM lead JOIN main USING (group_id) WHERE rk = 1 GROUP BY 1),
moved AS (SELECT p.group_id, string_agg(DISTINCT p.feature, ', ' ORDER BY p.feature) AS significant_changes FROM vec p JOIN vec o ON o.group_id = p.group_id AND o.feature = p.feature
    WHERE p.vector_id = 'point' AND abs(o.weight - p.weight) > 0.25 GROUP BY 1)"""


@query("importance_dominant_feature", with_(*_VEC, _LEAD) + "SELECT group_id, dominant_feature, round(dominant_consistency, 6) AS dominant_consistency, coalesce(significant_changes, '') AS significant_changes FROM main JOIN agreed USING (group_id) LEFT JOIN moved USING (group_id)")
def _(spark, sf):
    found = vectors(spark, sf)
    out = importance.dominant(found["point"], found["window"].unionByName(found["horizon"]))
    return out.select("group_id", "dominant_feature", F.round("dominant_consistency", 6).alias("dominant_consistency"), F.array_join("significant_changes", ", ").alias("significant_changes"))


@query("importance_composite", with_(*_VEC, _RANKS) + """SELECT s.group_id, round((0.4 * window_stability + 0.3 * plausibility + 0.3 * horizon_stability) / 1.0, 6) AS importance_score FROM steady s JOIN (
    SELECT group_id, sum(CASE WHEN abs(correlation) >= 0.05 THEN weight ELSE 0 END) / sum(weight) AS plausibility FROM vec WHERE vector_id = 'point' GROUP BY 1) p USING (group_id)""")
def _(spark, sf):
    found = vectors(spark, sf)
    point = found["point"]
    slim = {k: v.drop("correlation") for k, v in found.items()}
    out = importance.assemble(slim["point"], point.select("group_id", "model_name", "feature", "correlation"), slim["window"], slim["horizon"])
    return out.select("group_id", F.round("importance_score", 6).alias("importance_score"))


@query("importance_neutral_records", with_(*EVALUATION_CHAIN) + "SELECT group_id, model_name, 'univariate_fallback' AS method, CAST(1 AS DOUBLE) AS importance_score FROM evaluated WHERE evaluation = 'Survived'")
def _(spark, sf):
    return supplier_run(spark, sf).explained.select("group_id", "model_name", "method", "importance_score")


@query("importance_top_drivers", with_(*_VEC) + "SELECT group_id, feature, CAST(rk AS BIGINT) AS place, round(weight, 4) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY weight DESC, feature) AS rk FROM vec WHERE vector_id = 'point') WHERE rk <= 8")
def _(spark, sf):
    return importance.top_drivers(vectors(spark, sf)["point"]).select("group_id", "feature", *long("place"), "importance")


# -- ranking ----------------------------------------------------------------------------


def _inv(c):
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(1 - ({c} - min({c}) OVER g) / nullif(max({c}) OVER g - min({c}) OVER g, 0), 1) END"


_MW = {"mape": 0.15, "wmape": 0.35, "rmse": 0.2, "mae": 0.15, "smape": 0.15}


def RANK(source):
    total = " + ".join(f"coalesce({w} * {m}_score, 0)" for m, w in _MW.items())
    weight = " + ".join(f"CASE WHEN {m}_score IS NULL THEN 0 ELSE {w} END" for m, w in _MW.items())
    return f"""pool AS ({source}),
scaled AS (SELECT *, {", ".join(f"{_inv(m)} AS {m}_score" for m in _MW)} FROM pool WINDOW g AS (PARTITION BY group_id)),
accuracy AS (SELECT *, coalesce(({total}) / nullif({weight}, 0), 0.5) AS backtest_score FROM scaled),
bent AS (SELECT group_id, model_name, step, value, upper - lower AS width, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS bend FROM predictions
    WHERE fold = -1 WINDOW w AS (PARTITION BY group_id, model_name ORDER BY step)),
shape AS (SELECT group_id, model_name, stddev_pop(value) / coalesce(nullif(abs(avg(value)), 0), 1) AS variance, coalesce(avg(abs(bend)) / coalesce(nullif(abs(avg(value)), 0), 1), 0) AS smoothness,
    avg(width) / coalesce(nullif(abs(avg(value)), 0), 1) AS interval_width FROM bent GROUP BY 1, 2),
steady AS (SELECT s.*, {_inv("variance")} AS variance_score, {_inv("smoothness")} AS smoothness_score, coalesce({_inv("interval_width")}, 0.5) AS interval_score
    FROM shape s JOIN pool USING (group_id, model_name) WINDOW g AS (PARTITION BY group_id)),
combined AS (SELECT a.*, variance, smoothness, interval_width, variance_score, smoothness_score, interval_score, 0.4 * variance_score + 0.35 * smoothness_score + 0.25 * interval_score AS stability_score FROM accuracy a JOIN steady USING (group_id, model_name)),
ranked AS (SELECT *, 0.5 * backtest_score + 0.25 * stability_score + 0.25 * importance_score AS composite_score, row_number() OVER (PARTITION BY group_id ORDER BY round(backtest_score, 12) DESC, pos) AS backtest_rank,
    row_number() OVER (PARTITION BY group_id ORDER BY round(0.5 * backtest_score + 0.25 * stability_score + 0.25 * importance_score, 12) DESC, pos) AS final_rank FROM combined)"""


def all_ranked(spark, sf):
    run = supplier_run(spark, sf)
    return once(spark, f"ranked:{sf}", lambda: stable(ranking.rank_models(run.evaluated, run.forecasts)))


_ALL = (*EVALUATION_CHAIN, RANK("SELECT *, 0.5 AS importance_score FROM evaluated"))
_KEYS = "group_id, model_name"


@query("ranking_scaled_metrics", with_(*_ALL) + f"SELECT {_KEYS}, {r_(6, *[m + '_score' for m in _MW])} FROM scaled")
def _(spark, sf):
    return all_ranked(spark, sf).select("group_id", "model_name", *rounded(6, *[m + "_score" for m in _MW]))


@query("ranking_backtest_score", with_(*_ALL) + f"SELECT {_KEYS}, {r_(6, 'backtest_score')} FROM accuracy")
def _(spark, sf):
    return ranking.backtest_scores(supplier_run(spark, sf).evaluated).select("group_id", "model_name", *rounded(6, "backtest_score"))


@query("ranking_stability_measures", with_(*_ALL) + f"SELECT {_KEYS}, {r_(6, 'variance', 'smoothness', 'interval_width')} FROM shape")
def _(spark, sf):
    return ranking.stability_measures(supplier_run(spark, sf).forecasts).select("group_id", "model_name", *rounded(6, "variance", "smoothness", "interval_width"))


@query("ranking_stability_score", with_(*_ALL) + f"SELECT {_KEYS}, {r_(6, 'variance_score', 'smoothness_score', 'interval_score', 'stability_score')} FROM combined")
def _(spark, sf):
    return all_ranked(spark, sf).select("group_id", "model_name", *rounded(6, "variance_score", "smoothness_score", "interval_score", "stability_score"))


@query("ranking_composite", with_(*_ALL) + f"SELECT {_KEYS}, {r_(6, 'composite_score')} FROM ranked")
def _(spark, sf):
    return all_ranked(spark, sf).select("group_id", "model_name", *rounded(6, "composite_score"))


@query("ranking_ranks", with_(*_ALL) + f"SELECT {_KEYS}, CAST(backtest_rank AS BIGINT) AS backtest_rank, CAST(final_rank AS BIGINT) AS final_rank FROM ranked")
def _(spark, sf):
    return all_ranked(spark, sf).select("group_id", "model_name", *long("backtest_rank", "final_rank"))


RANKED = (*EVALUATION_CHAIN, RANK("SELECT *, 1.0 AS importance_score FROM evaluated WHERE evaluation = 'Survived'"))


@query("ranking_top_candidate", with_(*RANKED) + "SELECT s.group_id, model_name, round(composite_score, 6) AS composite_score FROM (SELECT DISTINCT group_id FROM series) s LEFT JOIN ranked r ON r.group_id = s.group_id AND final_rank = 1")
def _(spark, sf):
    run = supplier_run(spark, sf)
    top = ranking.top_candidates(run.series.select("group_id").distinct(), run.ranked)
    return top.select("group_id", "model_name", *rounded(6, "composite_score"))


# -- drift statistics ---------------------------------------------------------------------


def TWO_SAMPLE(samples: str) -> str:
    """All four statistics per `kk` from rows (kk, side, x) of relation `samples`."""
    return f"""facts AS (SELECT kk, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb, min(x) AS lo, max(x) AS hi, stddev_pop(x) FILTER (side = 'a') AS sa,
    list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) FILTER (side = 'a'))) AS deciles,
    list_sort(list_distinct(quantile_cont(x, [0, 0.5, 1]) FILTER (side = 'a'))) AS plain FROM {samples} GROUP BY 1),
shaped AS (SELECT *, CASE WHEN len(deciles) < 3 THEN plain ELSE deciles END AS edges FROM facts),
points AS (SELECT kk, x, count(*) FILTER (side = 'a') AS ca, count(*) FILTER (side = 'b') AS cb FROM {samples} GROUP BY 1, 2),
running AS (SELECT kk, x, sum(ca) OVER w AS fa, sum(cb) OVER w AS fb, lead(x) OVER (PARTITION BY kk ORDER BY x) AS nx FROM points WINDOW w AS (PARTITION BY kk ORDER BY x)),
cdf AS (SELECT kk, max(abs(fa * nb - fb * na)) / (any_value(na) * any_value(nb)) AS ks, coalesce(sum(abs(fa * nb - fb * na) * (nx - x)), 0) / (any_value(na) * any_value(nb)) AS area FROM running JOIN facts USING (kk) GROUP BY 1),
binned AS (SELECT kk, side, 1 + len(list_filter(edges[2:-2], lambda e: e <= x)) AS pb, 1 + len(list_filter(range(1, 10), lambda i: lo + i * ((hi - lo) / 10) <= x)) AS jb FROM {samples} JOIN shaped USING (kk)),
pgrid AS (SELECT kk, b, len(edges) - 1 AS k, na, nb FROM shaped, unnest(range(1, len(edges))) u(b) WHERE len(edges) >= 2),
pcell AS (SELECT g.kk, g.b, (count(*) FILTER (side = 'a') + 1) / any_value(na + k) AS p, (count(*) FILTER (side = 'b') + 1) / any_value(nb + k) AS q FROM pgrid g LEFT JOIN binned n ON n.kk = g.kk AND n.pb = g.b GROUP BY 1, 2),
psis AS (SELECT kk, sum((q - p) * ln(q / p)) AS psi FROM pcell GROUP BY 1),
jgrid AS (SELECT kk, b, na, nb FROM facts, range(1, 11) r(b) WHERE lo < hi),
jcell AS (SELECT g.kk, g.b, (count(*) FILTER (side = 'a') + 1e-9) / any_value(na + 1e-8) AS p, (count(*) FILTER (side = 'b') + 1e-9) / any_value(nb + 1e-8) AS q FROM jgrid g LEFT JOIN binned n ON n.kk = g.kk AND n.jb = g.b GROUP BY 1, 2),
jss AS (SELECT kk, sqrt(greatest(0, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q)))) / (2 * ln(2))) AS js FROM jcell GROUP BY 1),
stats AS (SELECT f.kk, ks AS kolmogorov_smirnov, CASE WHEN sa > 0 THEN area / sa ELSE area END AS wasserstein_distance, coalesce(psi, 0) AS population_stability_index, coalesce(js, 0) AS jensen_shannon_divergence
    FROM facts f JOIN cdf USING (kk) LEFT JOIN psis USING (kk) LEFT JOIN jss USING (kk))"""


WINDOWED = "win AS (SELECT group_id, y, CAST(least(n, 36) AS BIGINT) AS m, t - (n - least(n, 36)) + 1 AS p FROM series WHERE t >= n - least(n, 36))"
_BOTH = """pairs2 AS (SELECT group_id || '~' || model_name AS kk, 'b' AS side, value AS x FROM predictions WHERE fold = -1
    UNION ALL SELECT w.group_id || '~' || m.model_name, 'a', y FROM win w, (SELECT DISTINCT model_name FROM predictions) m)"""
_CURRENT = (*EVALUATION_CHAIN, WINDOWED, _BOTH, TWO_SAMPLE("pairs2"))


def forecast_pairs(spark, sf):
    run = supplier_run(spark, sf)
    return drift.forecast_samples(run.forecasts).join(run.chosen.select("group_id", "history"), "group_id")


for _alg in S.ALGORITHMS:
    @query(f"drift_{_alg}", with_(*_CURRENT) + f"SELECT split_part(kk, '~', 1) AS group_id, split_part(kk, '~', 2) AS model_name, round({_alg}, 6) AS statistic FROM stats")
    def _(spark, sf, alg=_alg):
        scored = S.two_sample(forecast_pairs(spark, sf), F.lit(alg), F.col("history"), F.col("current"))
        return scored.select("group_id", "model_name", F.round("statistic", 6).alias("statistic"))


_SHAPIRO = "weights(n, i, a) AS (VALUES " + ", ".join(f"({n}, {i}, {a!r})" for n in range(20, 37) for i, a in enumerate(S.shapiro_weights(n), 1)) + ")"
CHOSEN = _SHAPIRO + """,
sorted AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY y) AS i FROM win),
sw AS (SELECT group_id, any_value(m) AS n, count(DISTINCT y) AS u, pow(sum(a * y), 2) / nullif(var_pop(y) * count(*), 0) AS w FROM sorted LEFT JOIN weights ON n = m AND weights.i = sorted.i GROUP BY 1),
zs AS (SELECT *, (ln(1 - w) - (-1.5861 + ln(n) * (-0.31082 + ln(n) * (-0.083751 + ln(n) * 0.0038915)))) / exp(-0.4803 + ln(n) * (-0.082676 + ln(n) * 0.0030302)) AS z FROM sw),
tails AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM zs),
ps AS (SELECT *, CASE WHEN z >= 0 THEN q ELSE 1 - q END AS p FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) AS q FROM tails)),
chosen AS (SELECT group_id, n, u, CASE WHEN NOT (n < 20 OR u < 8 OR u * 1.0 / n < 0.15) THEN p END AS p, CASE WHEN n < 20 OR u < 8 OR u * 1.0 / n < 0.15 THEN 'population_stability_index' WHEN p > 0.05 THEN 'wasserstein_distance'
    WHEN n >= 30 THEN 'kolmogorov_smirnov' ELSE 'jensen_shannon_divergence' END AS algorithm,
    CASE WHEN n < 24 THEN 'percentile' WHEN n < 60 THEN 'bootstrap' ELSE 'kernel_density' END AS method FROM ps)"""


@query("drift_normality", with_(SERIES, WINDOWED, CHOSEN) + "SELECT group_id, round(p, 5) AS p_value FROM chosen")
def _(spark, sf):
    return supplier_run(spark, sf).chosen.select("group_id", F.round("p_value", 5).alias("p_value"))


@query("drift_algorithm_choice", with_(SERIES, WINDOWED, CHOSEN) + "SELECT group_id, n AS sample_size, u AS unique_values, algorithm, method FROM chosen")
def _(spark, sf):
    out = supplier_run(spark, sf).chosen
    return out.select("group_id", *long("sample_size", "unique_values"), "algorithm", drift.threshold_method(F.col("sample_size")).alias("method"))


_CUST = """cmonths AS (SELECT CAST(o_custkey AS VARCHAR) AS group_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
series AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY group_id) AS n FROM cmonths)"""


def customer_chosen(spark, sf):
    def build():
        roles = Roles("o_orderdate", "o_totalprice", ("o_custkey",))
        months = clean.to_months(table(spark, sf, "orders"), roles).withColumn("o_totalprice", F.round("o_totalprice", 2))
        return stable(drift.choose_algorithm(drift.history_samples(series_ops.build_series(months, roles), "Monthly", 12)))

    return once(spark, f"customers:{sf}", build)


_CHUNKS = """chunked AS (SELECT *, greatest(2, least(4, m // 6)) AS k FROM win WHERE m >= 2),
cut AS (SELECT group_id, y, k, 1 + least((p - 1) // (m // k + 1), m % k) + CASE WHEN p - 1 >= (m % k) * (m // k + 1) THEN (p - 1 - (m % k) * (m // k + 1)) // (m // k) ELSE 0 END AS raw,
    CASE WHEN p - 1 < (m % k) * (m // k + 1) THEN (p - 1) // (m // k + 1) ELSE m % k + (p - 1 - (m % k) * (m // k + 1)) // (m // k) END AS c FROM chunked),
parts AS (SELECT group_id || '~' || c AS kk, 'a' AS side, y AS x FROM cut WHERE c <= k - 2 UNION ALL SELECT group_id || '~' || (c - 1), 'b', y FROM cut WHERE c >= 1)"""


@query("drift_null_from_chunks", with_(_CUST, WINDOWED, _CHUNKS, TWO_SAMPLE("parts")) + "SELECT split_part(kk, '~', 1) AS group_id, CAST(split_part(kk, '~', 2) AS BIGINT) AS iteration, round(wasserstein_distance, 6) AS statistic FROM stats")
def _(spark, sf):
    chosen = customer_chosen(spark, sf).withColumn("algorithm", F.lit(S.WASSERSTEIN))
    nulls = drift.null_statistics(chosen, Drift(method="percentile"))
    return nulls.select("group_id", *long("iteration"), F.round("statistic", 6).alias("statistic"))


@query("drift_threshold_percentile", with_(_CUST, WINDOWED, _CHUNKS, TWO_SAMPLE("parts")) + """SELECT g.group_id, round(greatest(0, coalesce(q, 0)), 6) AS threshold, coalesce(c, 0) AS null_size FROM (SELECT DISTINCT group_id FROM series) g LEFT JOIN (
    SELECT split_part(kk, '~', 1) AS group_id, quantile_cont(population_stability_index, 0.95) AS q, count(*) AS c FROM stats GROUP BY 1) s USING (group_id)""")
def _(spark, sf):
    options = Drift(method="percentile")
    chosen = customer_chosen(spark, sf).withColumn("algorithm", F.lit(S.PSI))
    limits = drift.thresholds(chosen, drift.key_nulls(chosen, options), options)
    return limits.select("group_id", F.round("threshold", 6).alias("threshold"), "null_size")


_DRAWS = """halves AS (SELECT DISTINCT group_id, m, greatest(1, m // 2) AS half FROM win WHERE m >= 2),
slots AS (SELECT group_id, it, 1 AS side, i, 0 AS off, half AS size FROM halves, range(200) a(it), unnest(range(1, half + 1)) u(i)
    UNION ALL SELECT group_id, it, 2, i, half, m - half FROM halves, range(200) a(it), unnest(range(1, m - half + 1)) u(i)),
h0 AS (SELECT *, (it * 7919 + i * 104729 + side * 1299709 + 42 * 15485863) & 4294967295 AS h FROM slots),
h1 AS (SELECT * REPLACE ((xor(h, h >> 15) * 739982445) & 4294967295 AS h) FROM h0),
h2 AS (SELECT * REPLACE ((xor(h, h >> 12) * 695872825) & 4294967295 AS h) FROM h1),
h3 AS (SELECT * REPLACE (xor(h, h >> 15) AS h) FROM h2),
boot AS (SELECT h.group_id || '~' || h.it AS kk, CASE side WHEN 1 THEN 'a' ELSE 'b' END AS side, w.y AS x FROM h3 h JOIN win w ON w.group_id = h.group_id AND w.p = h.off + h.h % h.size + 1)"""
LIMITS = """nulls AS (SELECT c.group_id, s.kk, CASE algorithm WHEN 'wasserstein_distance' THEN wasserstein_distance WHEN 'kolmogorov_smirnov' THEN kolmogorov_smirnov
    WHEN 'population_stability_index' THEN population_stability_index ELSE jensen_shannon_divergence END AS statistic FROM stats s JOIN chosen c ON c.group_id = split_part(s.kk, '~', 1)),
limits AS (SELECT c.group_id, method, greatest(0, coalesce(quantile_cont(statistic, 0.95), 0)) AS threshold, count(statistic) AS null_size FROM chosen c LEFT JOIN nulls USING (group_id) GROUP BY 1, 2)"""
_BOOT = (WINDOWED, CHOSEN, _DRAWS, TWO_SAMPLE("boot"), LIMITS)


@query("drift_null_bootstrap", with_(SERIES, *_BOOT) + "SELECT group_id, CAST(split_part(kk, '~', 2) AS BIGINT) AS iteration, round(statistic, 6) AS statistic FROM nulls")
def _(spark, sf):
    nulls = drift.null_statistics(supplier_run(spark, sf).chosen)
    return nulls.select("group_id", *long("iteration"), F.round("statistic", 6).alias("statistic"))


@query("drift_thresholds", with_(SERIES, *_BOOT) + "SELECT group_id, method, round(threshold, 6) AS threshold, null_size FROM limits")
def _(spark, sf):
    return supplier_run(spark, sf).thresholds.select("group_id", "method", F.round("threshold", 6).alias("threshold"), "null_size")


def _drawn(iteration: str, position: int, side: int, size: str) -> str:
    """`samples.draw` as nested SQL."""
    return f"{_mixed(f'{iteration} * 7919 + {position} * 104729 + {side} * 1299709 + 42 * 15485863')} % {size}"


def _mixed(first: str) -> str:
    """The whole-number hash of `samples.draw` over its starting value."""
    h = f"(({first}) & 4294967295)"
    h = f"((xor({h}, {h} >> 15) * 739982445) & 4294967295)"
    h = f"(SELECT (xor(x, x >> 12) * 695872825) & 4294967295 FROM (SELECT {h} AS x))"
    return f"(SELECT xor(x, x >> 15) FROM (SELECT {h} AS x))"


_KDE = f"""placed AS (SELECT group_id, statistic, row_number() OVER (PARTITION BY group_id ORDER BY statistic) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS size FROM nulls),
density AS (SELECT group_id, CAST(count(*) AS BIGINT) AS size, stddev_samp(statistic) AS spread, quantile_cont(statistic, 0.95) AS read FROM nulls GROUP BY 1),
turns AS (SELECT i, sqrt(-2 * ln(({_drawn("i", 5, 5, "1000000")} + 0.5) / 1000000.0)) * cos(({_drawn("i", 6, 6, "1000000")} + 0.5) / 1000000.0 * 6.283185307179586) AS normal FROM range(2000) x(i)),
picks AS (SELECT group_id, spread * pow(size, -0.2) * normal AS noise, {_drawn("i", 4, 4, "size")} AS r FROM density, turns),
smoothed AS (SELECT p.group_id, quantile_cont(statistic + noise, 0.95) AS threshold FROM picks p JOIN placed s ON s.group_id = p.group_id AND s.r = p.r GROUP BY 1)"""


@query("drift_threshold_kernel_density", with_(SERIES, *_BOOT, _KDE) + """SELECT c.group_id, 'kernel_density' AS method, round(greatest(0, coalesce(CASE WHEN spread > 0 THEN s.threshold ELSE read END, 0)), 5) AS threshold, coalesce(size, 0) AS null_size
    FROM chosen c LEFT JOIN density USING (group_id) LEFT JOIN smoothed s ON s.group_id = c.group_id""")
def _(spark, sf):
    chosen, options = supplier_run(spark, sf).chosen, Drift(method="kernel_density")
    limits = drift.thresholds(chosen, drift.key_nulls(chosen, options), options)
    return limits.select("group_id", "method", F.round("threshold", 5).alias("threshold"), "null_size")


@query("drift_samples", with_(*EVALUATION_CHAIN, WINDOWED) + """SELECT group_id, any_value(m) AS history_rows, round(sum(y), 2) AS history_sum FROM win GROUP BY 1""")
def _(spark, sf):
    out = drift.history_samples(supplier_series(spark, sf), "Monthly", 12)
    return out.select("group_id", F.size("history").cast("long").alias("history_rows"), F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x), 2).alias("history_sum"))


# The SQL of the whole decision names its sample relations twice, once per comparison.
_NOW = TWO_SAMPLE("pairs2")
for _part in ("facts", "shaped", "points", "running", "cdf", "binned", "pgrid", "pcell", "psis", "jgrid", "jcell", "jss", "stats"):
    import re as _re

    _NOW = _re.sub(rf"\b{_part}\b", f"now_{_part}", _NOW)
VERDICT = """gate AS (SELECT split_part(kk, '~', 1) AS group_id, split_part(kk, '~', 2) AS model_name, c.algorithm, l.method, l.threshold, CASE algorithm WHEN 'wasserstein_distance' THEN wasserstein_distance
    WHEN 'kolmogorov_smirnov' THEN kolmogorov_smirnov WHEN 'population_stability_index' THEN population_stability_index ELSE jensen_shannon_divergence END AS statistic
    FROM now_stats JOIN chosen c ON c.group_id = split_part(kk, '~', 1) JOIN limits l ON l.group_id = c.group_id),
gated AS (SELECT g.*, statistic <= threshold AS passed FROM gate g JOIN ranked USING (group_id, model_name)),
walk AS (SELECT r.*, algorithm, method, threshold, statistic, coalesce(passed, false) AS passed, min(CASE WHEN passed THEN final_rank END) OVER (PARTITION BY r.group_id) AS winner_rank FROM ranked r LEFT JOIN gated USING (group_id, model_name)),
picked AS (SELECT s.group_id, coalesce(w.model_name, 'seasonal_naive') AS model_name, CASE WHEN w.model_name IS NULL THEN 'Fallback Model Used' ELSE 'Selected' END AS status, w.model_name IS NULL AS fallback_used,
    w.composite_score, w.backtest_rank, w.final_rank, w.algorithm, w.method, w.statistic, w.threshold FROM (SELECT DISTINCT group_id FROM series) s LEFT JOIN walk w ON w.group_id = s.group_id AND w.final_rank = w.winner_rank)"""
DECISION = (*RANKED, WINDOWED, CHOSEN, _DRAWS, TWO_SAMPLE("boot"), LIMITS, _BOTH, _NOW, VERDICT)


@query("drift_verdicts", with_(*DECISION) + "SELECT group_id, model_name, algorithm, method, round(statistic, 6) AS statistic, round(threshold, 6) AS threshold, passed FROM gated")
def _(spark, sf):
    return supplier_run(spark, sf).drift.select("group_id", "model_name", "algorithm", "method", *rounded(6, "statistic", "threshold"), "passed")


@query("drift_stage_trail", with_(*DECISION) + """SELECT group_id, model_name, CAST(u.pos AS BIGINT) AS pos, u.stage FROM gated, (VALUES (0, 'Dynamic Drift Selection'), (1, 'Threshold Validation'), (2, 'Drift Validation')) u(pos, stage)""")
def _(spark, sf):
    out = supplier_run(spark, sf).drift
    return out.select("group_id", "model_name", F.posexplode("trail").alias("pos", "entry")).select("group_id", "model_name", *long("pos"), F.col("entry.stage").alias("stage"))


# -- selection ----------------------------------------------------------------------------


@query("selection_production", with_(*DECISION) + "SELECT group_id, model_name, status, fallback_used, round(composite_score, 6) AS composite_score, CAST(backtest_rank AS BIGINT) AS backtest_rank, CAST(final_rank AS BIGINT) AS final_rank, algorithm, round(statistic, 6) AS statistic FROM picked")
def _(spark, sf):
    out = supplier_run(spark, sf).selection
    return out.select("group_id", "model_name", "status", "fallback_used", F.round("composite_score", 6).alias("composite_score"), *long("backtest_rank", "final_rank"), "algorithm", F.round("statistic", 6).alias("statistic"))


@query("run_from_raw", with_(*DECISION) + "SELECT group_id, model_name, status, fallback_used, round(composite_score, 6) AS composite_score, CAST(final_rank AS BIGINT) AS final_rank FROM picked")
def _(spark, sf):
    """A whole run, gates included, from rows that are monthly already."""
    run = once(spark, f"raw-run:{sf}", lambda: forecast.run(supplier_months(spark, sf), SUPPLIER_ROLES, CLOSED_FORM))
    return run.selection.select("group_id", "model_name", "status", "fallback_used", F.round("composite_score", 6).alias("composite_score"), *long("final_rank"))


_RAW_DAYS = ("round(sum(l_extendedprice * (1 - l_discount)), 4) AS y FROM lineitem GROUP BY 1, 2", """sum(revenue) AS y
    FROM (SELECT DISTINCT l_suppkey, l_shipdate, round(l_extendedprice * (1 - l_discount), 2) AS revenue FROM lineitem) GROUP BY 1, 2""")


@query("run_from_raw_days", with_(*DECISION).replace(*_RAW_DAYS) + "SELECT group_id, model_name, status, fallback_used, round(composite_score, 5) AS composite_score, CAST(final_rank AS BIGINT) AS final_rank FROM picked")
def _(spark, sf):
    """A whole run from daily rows as they lie: grain, quality gate, types, duplicates, missing values and roll-up all inside it."""
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    days = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", revenue.alias("revenue"))
    run = once(spark, f"raw-days:{sf}", lambda: forecast.run(days, SUPPLIER_ROLES, CLOSED_FORM))
    return run.selection.select("group_id", "model_name", "status", "fallback_used", F.round("composite_score", 5).alias("composite_score"), *long("final_rank"))


# A gate at the median of the null instead of its 95th percentile: candidates are refused and groups fall back.
_TIGHT = Drift(percentile=0.5)
_TIGHT_SQL = with_(*DECISION).replace("quantile_cont(statistic, 0.95)", "quantile_cont(statistic, 0.5)")


def tight_gate(spark, sf):
    def build():
        run = supplier_run(spark, sf)
        limits = drift.thresholds(run.chosen, drift.key_nulls(run.chosen, _TIGHT), _TIGHT)
        kept = run.forecasts.join(run.ranked.select("group_id", "model_name"), ["group_id", "model_name"], "left_semi")
        judged = stable(selection.judged_candidates(run.ranked, drift.drift_verdicts(run.chosen, limits, drift.forecast_samples(kept))))
        groups = run.series.select("group_id").distinct()
        return judged, stable(selection.select_production(groups, judged, run.naive, selection.failures(run.trained, judged)))

    return once(spark, f"tight:{sf}", build)


@query("selection_rejected_tight", _TIGHT_SQL + "SELECT group_id, model_name, CAST(final_rank AS BIGINT) AS final_rank, algorithm, round(statistic, 6) AS statistic, round(threshold, 6) AS threshold FROM walk WHERE winner_rank IS NULL OR final_rank < winner_rank")
def _(spark, sf):
    out = selection.rejected(tight_gate(spark, sf)[0])
    return out.select("group_id", "model_name", *long("final_rank"), "algorithm", *rounded(6, "statistic", "threshold"))


@query("selection_production_tight", _TIGHT_SQL + """SELECT p.group_id, p.model_name, status, fallback_used, CASE WHEN NOT fallback_used THEN NULL WHEN c.names IS NULL THEN 'No ranked candidate survived earlier validation stages.'
        ELSE 'All ' || k || ' evaluated model(s) failed validation (' || names || ').' END AS fallback_trigger, coalesce(gone, 0) AS refused
    FROM picked p LEFT JOIN (SELECT group_id, count(*) AS k, string_agg(model_name, ', ' ORDER BY final_rank) AS names, count(*) FILTER (winner_rank IS NULL OR final_rank < winner_rank) AS gone FROM walk GROUP BY 1) c USING (group_id)""")
def _(spark, sf):
    out = tight_gate(spark, sf)[1]
    refused = F.when(F.col("rejected_candidates").isNull(), 0).otherwise(F.size("rejected_candidates"))
    return out.select("group_id", "model_name", "status", "fallback_used", "fallback_trigger", refused.cast("long").alias("refused"))


@query("selection_rejected", with_(*DECISION) + "SELECT group_id, model_name, CAST(final_rank AS BIGINT) AS final_rank, algorithm, round(statistic, 6) AS statistic, round(threshold, 6) AS threshold FROM walk WHERE winner_rank IS NULL OR final_rank < winner_rank")
def _(spark, sf):
    out = selection.rejected(supplier_run(spark, sf).judged)
    return out.select("group_id", "model_name", *long("final_rank"), "algorithm", *rounded(6, "statistic", "threshold"))


@query("selection_fallback_trigger", with_(*DECISION) + """SELECT p.group_id, CASE WHEN c.names IS NULL THEN 'No ranked candidate survived earlier validation stages.' ELSE 'All ' || k || ' evaluated model(s) failed validation (' || names || ').' END AS fallback_trigger
    FROM picked p LEFT JOIN (SELECT group_id, count(*) AS k, string_agg(model_name, ', ' ORDER BY final_rank) AS names FROM ranked GROUP BY 1) c USING (group_id) WHERE fallback_used""")
def _(spark, sf):
    return supplier_run(spark, sf).selection.where("fallback_used").select("group_id", "fallback_trigger")


@query("selection_report", with_(*DECISION) + """SELECT count(*) AS groups, count(*) FILTER (status = 'Selected') AS selected, count(*) FILTER (fallback_used) AS fallback_used, CAST(0 AS BIGINT) AS no_model, CAST(0 AS BIGINT) AS failed FROM picked""")
def _(spark, sf):
    return selection.selection_report(supplier_run(spark, sf).selection)


def strict_selection(spark, sf):
    """The same run gated by thresholds of zero: every group falls back."""
    def build():
        run = supplier_run(spark, sf)
        judged = selection.judged_candidates(run.ranked, run.drift.withColumn("passed", F.col("statistic") <= 0))
        groups = run.series.select("group_id").distinct()
        return stable(selection.select_production(groups, judged, run.naive))

    return once(spark, f"strict:{sf}", build)


@query("selection_fallback_report", with_(*RANKED) + """SELECT s.group_id, CASE WHEN k IS NULL THEN 'No ranked candidate survived earlier validation stages.' ELSE 'All ' || k || ' evaluated model(s) failed validation (' || names || ').' END AS fallback_trigger,
    coalesce(names, '') AS original_candidates FROM (SELECT DISTINCT group_id FROM series) s LEFT JOIN (SELECT group_id, count(*) AS k, string_agg(model_name, ', ' ORDER BY final_rank) AS names FROM ranked GROUP BY 1) USING (group_id)""")
def _(spark, sf):
    return selection.fallback_report(strict_selection(spark, sf)).drop("reasons")


EXPORT = """winning AS (SELECT p.* FROM predictions p JOIN picked k USING (group_id, model_name) WHERE p.fold = -1 AND NOT k.fallback_used
    UNION ALL SELECT v.*, 9 FROM naive v JOIN picked k USING (group_id) WHERE v.fold = -1 AND k.fallback_used)"""


@query("selection_forecast_export", with_(*DECISION, EXPORT) + "SELECT group_id, model_name, ds AS date, round(value, 2) AS value, round(lower, 2) AS lower, round(upper, 2) AS upper FROM winning")
def _(spark, sf):
    from keycast.sources import tables

    run = supplier_run(spark, sf)
    return tables.forecast_rows(run.winning, run.selection).select("group_id", "model_name", "date", *rounded(2, "value", "lower", "upper"))


# -- tree models: fitted, so only their rows are checked --------------------------------------

from keycast.operators import folds as _folds  # noqa: E402
from keycast.operators.models import trees  # noqa: E402


def full_matrix(spark, sf) -> DataFrame:
    def build():
        frame = _folds.frame(supplier_series(spark, sf)).where("fold = -1")
        return stable(trees.training_rows(frame))

    return once(spark, f"trees:{sf}", build)


@query("model_boosted_trees")
def _(spark, sf):
    return trees.predict(_folds.frame(supplier_series(spark, sf)), "boosted_trees")


@query("model_random_forest")
def _(spark, sf):
    return trees.predict(_folds.frame(supplier_series(spark, sf)), "random_forest")


@query("model_parameter_search")
def _(spark, sf):
    return trees.search(full_matrix(spark, sf), "random_forest")


@query("importance_tree_records")
def _(spark, sf):
    return trees.importance_records(full_matrix(spark, sf), "random_forest").drop("significant_changes")


@query("importance_permutation")
def _(spark, sf):
    records = trees.importance_records(full_matrix(spark, sf), "random_forest", Importance(holdout=True))
    return records.drop("significant_changes")


# -- attribution of one pooled model to keys: a fixed linear model, so that SQL can follow it --------

_LINEAR = {"lag_1": 0.3, "lag_2": -0.5, "lag_12": 0.15, "rolling_mean_6": -0.2, "month": 40.0}


_CHANGE = " + ".join(f"{w!r} * {f}" for f, w in _LINEAR.items())
_GAINS = f"""located AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY group_id) AS c, {_CHANGE} AS change FROM matrix),
hashed AS (SELECT *, {_mixed("42 * 7919 + (p + 1) * 104729 + 8 * 1299709 + 42 * 15485863")} % 2000000000 AS h FROM located),
turned AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY h, p) - 1 AS place FROM hashed),
gained AS (""" + " UNION ALL ".join(
    f"SELECT a.group_id, a.p, a.c, '{f}' AS feature, abs(a.change + {_LINEAR.get(f, 0.0)!r} * (b.{f} - a.{f}) - a.label) - abs(a.change - a.label) AS gain FROM turned a JOIN turned b ON b.group_id = a.group_id AND b.place = a.p" for f in NAMES) + f"""),
drawn AS (SELECT group_id, r, {_mixed("r * 7919 + (p + 1) * 104729 + 7 * 1299709 + 42 * 15485863")} % c AS p, count(*) AS times FROM located, range(3) x(r) GROUP BY 1, 2, 3),
parted AS (SELECT *, 'point' AS vector_id, 1 AS times FROM gained
    UNION ALL SELECT g.*, 'resample_' || r, times FROM gained g JOIN drawn d ON d.group_id = g.group_id AND d.p = g.p
    UNION ALL SELECT *, 'segment_' || least(p // (c // 2), 1), 1 FROM gained WHERE c >= 16
    UNION ALL SELECT *, 'tail_0.5', 1 FROM gained WHERE p >= c - greatest(8, c // 2) UNION ALL SELECT *, 'tail_1.0', 1 FROM gained),
weighed AS (SELECT group_id, vector_id, feature, greatest(0, sum(gain * times) / sum(times)) AS weight FROM parted GROUP BY 1, 2, 3),
shares AS (SELECT group_id, vector_id, feature, coalesce(weight / nullif(sum(weight) OVER (PARTITION BY group_id, vector_id), 0), weight) AS weight FROM weighed)"""


def attributed_vectors(spark, sf) -> dict[str, DataFrame]:
    def build():
        rows = matrix(spark, sf).select("group_id", "t", "label", F.lit(1.0).alias("width"), *[F.col(c).cast("double").alias(c) for c in NAMES])
        change = sum((F.col(f) * w for f, w in _LINEAR.items()), F.lit(0.0))
        found = trees.gains(rows, lambda r: r.withColumn("change", change), NAMES)
        return {k: stable(v) for k, v in trees.attributed(found, "linear").items()}

    return once(spark, f"attributed:{sf}", build)


@query("importance_key_attribution", with_(SERIES, _MATRIX, _GAINS) + "SELECT group_id, vector_id, feature, round(weight, 6) AS weight FROM shares")
def _(spark, sf):
    found = attributed_vectors(spark, sf)
    every = found["point"].unionByName(found["window"]).unionByName(found["horizon"])
    return every.select("group_id", "vector_id", "feature", F.round("weight", 6).alias("weight"))


@query("importance_key_drivers", with_(SERIES, _MATRIX, _GAINS) + """SELECT dominant_feature, count(*) AS keys FROM (
    SELECT group_id, feature AS dominant_feature, row_number() OVER (PARTITION BY group_id ORDER BY weight DESC, feature) AS rk FROM shares WHERE vector_id = 'point') WHERE rk = 1 GROUP BY 1""")
def _(spark, sf):
    found = attributed_vectors(spark, sf)
    lead = importance.dominant(found["point"], found["window"])
    return lead.groupBy("dominant_feature").agg(F.count(F.lit(1)).alias("keys"))
