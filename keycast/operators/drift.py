"""Drift gate: statistic chosen per key, threshold from the key's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast import registry
from keycast.config import Drift
from keycast.functions import resampling
from keycast.functions import samples as S
from keycast.functions.skew import spread
from keycast.operators.metrics import finite
from keycast.operators.rules import reference_window


def history_samples(series: DataFrame, grain: str | None, horizon: int) -> DataFrame:
    """`group_id, history`: the reference window in time order. Its length is bounded by the grain and horizon."""
    rows = reference_window(series, grain, horizon)
    ordered = F.sort_array(F.collect_list(F.struct("t", "y")))
    return rows.groupBy("group_id").agg(F.transform(ordered, lambda r: r["y"]).alias("history"))


def forecast_samples(forecasts: DataFrame) -> DataFrame:
    """`group_id, model_name, current`: finite forecast values, at most one horizon."""
    return forecasts.where(finite(F.col("value"))).groupBy("group_id", "model_name").agg(F.collect_list("value").alias("current"))


def normality(samples: DataFrame, options: Drift = Drift()) -> DataFrame:
    """Add `normality_test` and `p_value`.

    Shapiro–Wilk is a dot product of the sorted sample with weights that its
    length sets; they are worked out once per length that occurs. Samples longer than
    `shapiro_max_rows` use D'Agostino–Pearson from their moments.
    """
    out = S.pinned(samples.withColumn("sample_size", F.size("history")), _sorted=F.sort_array("history"))
    lengths = out.select("sample_size").where(F.col("sample_size").between(12, options.shapiro_max_rows)).distinct()
    # One row per length up to shapiro_max_rows, 16 MB if all 2,000 occur.
    out = out.join(F.broadcast(S.with_shapiro_weights(lengths, "sample_size", "weights")), "sample_size", "left")
    out = S.pinned(out, _m=S.moments(F.col("_sorted")))
    dot = F.aggregate(F.zip_with("_sorted", "weights", lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)
    out = S.pinned(out, _w=F.when(F.col("weights").isNotNull(), dot * dot / F.nullif(F.col("_m.m2"), F.lit(0.0))))
    spread = F.sqrt(F.col("_m.m2") / F.col("_m.n"))
    power = lambda k: F.aggregate("_sorted", F.lit(0.0), lambda s, x: s + F.pow((x - F.col("_m.mean")) / spread, F.lit(k))) / F.col("_m.n")
    out = S.pinned(out, _k=F.when(F.col("weights").isNull() & (F.col("_m.m2") > 0) & (F.col("sample_size") >= options.min_rows), F.struct(power(3).alias("s"), power(4).alias("k"))))
    out = S.pinned(out, _z=S.shapiro_z(F.col("_w"), F.col("sample_size").cast("double")))
    out = S.with_dagostino_p(out, F.col("_k.s"), F.col("_k.k"), F.col("sample_size"), "_p")
    p = F.when(F.col("_m.m2") == 0, F.lit(1.0)).when(F.col("weights").isNotNull(), 1 - S.normal_cdf(F.col("_z"))).otherwise(F.col("_p"))
    test = F.when(F.col("weights").isNotNull(), "Shapiro-Wilk").otherwise("D'Agostino-Pearson")
    return out.withColumn("normality_test", test).withColumn("p_value", p).drop("_sorted", "_m", "_w", "_k", "_z", "_p", "weights")


def choose_algorithm(samples: DataFrame, options: Drift = Drift()) -> DataFrame:
    """Add `sample_size, unique_values, normality_test, p_value, algorithm`; first match wins."""
    out = normality(samples, options).withColumn("unique_values", F.size(F.array_distinct("history")))
    n, unique = F.col("sample_size"), F.col("unique_values")
    discrete = (n < options.min_rows) | (unique < options.min_distinct) | (unique / n < options.min_distinct_ratio)
    algorithm = (
        F.when(discrete, S.PSI)
        .when(F.col("p_value") > options.alpha, S.WASSERSTEIN)
        .when(n >= options.ks_min_rows, S.KS)
        .otherwise(S.JS)
    )
    if options.algorithm != "auto":
        algorithm = F.lit(options.algorithm)
    tested = lambda c: F.when(~discrete, F.col(c))
    return (
        out.withColumn("algorithm", algorithm)
        .withColumn("normality_test", tested("normality_test"))
        .withColumn("p_value", tested("p_value"))
    )


def threshold_method(n: Column, options: Drift = Drift()) -> Column:
    if options.method != "auto":
        return F.lit(options.method)
    return F.when(n < options.bootstrap_from, "percentile").when(n < options.kde_from, "bootstrap").otherwise("kernel_density")


def chunk_bounds(n: Column) -> Column:
    """Number of consecutive chunks a short history is cut into."""
    return F.greatest(F.lit(2), F.least(F.lit(4), F.floor(n / 6))).cast("int")


def _chunk_pairs(n: Column) -> Column:
    """(reference, current) of each adjacent chunk pair, sizes as even as possible, larger ones first."""
    k = chunk_bounds(n)
    size, extra = F.floor(n / k).cast("int"), F.pmod(n, k).cast("int")
    begin = lambda i: i * size + F.least(i, extra)
    part = lambda i: F.slice("history", begin(i) + 1, begin(i + 1) - begin(i))
    return F.transform(
        F.sequence(F.lit(0), k - 2),
        lambda i: F.struct(i.cast("int").alias("iteration"), part(i).alias("a"), part(i + 1).alias("b")),
    )


def _resample_pairs(n: Column, options: Drift) -> Column:
    """(earlier, later) bootstrap resamples of the two halves, drawn with whole-number hashing."""
    half = F.greatest(F.lit(1), F.floor(n / 2)).cast("int")

    def pick(iteration: Column, side: int, offset: Column, size: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.element_at("history", offset + S.draw(iteration, i, side, size, options.seed) + 1),
        )

    return F.transform(
        F.sequence(F.lit(0), F.lit(options.resamples - 1)),
        lambda r: F.struct(
            r.cast("int").alias("iteration"),
            pick(r, 1, F.lit(0), half).alias("a"),
            pick(r, 2, half, n - half).alias("b"),
        ),
    )


def _ready(chosen: DataFrame, options: Drift) -> DataFrame:
    """Keys with a history to compare, spread out once, and the method of their null."""
    n = F.col("sample_size")
    return spread(chosen.where(n >= 2), "group_id").withColumn("method", threshold_method(n, options))


def _registered() -> Column:
    """Keys whose statistic or null is a registered expression."""
    named = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False)) if names else F.lit(False)
    return named("algorithm", registry.STATISTICS) | named("method", registry.NULLS)


def _expressed(ready: DataFrame, options: Drift) -> DataFrame:
    """`null_statistics` of keys whose statistic or null is a registered expression."""
    n = F.col("sample_size")
    pairs = F.when(F.col("method") == "percentile", _chunk_pairs(n))
    for method, build in registry.NULLS.items():
        pairs = pairs.when(F.col("method") == method, build(n))
    pairs = pairs.otherwise(_resample_pairs(n, options))
    ready = S.pinned(ready, _pairs=pairs)  # a generator over the raw expression would evaluate it twice
    rows = ready.select("group_id", "algorithm", "method", F.inline("_pairs"))
    rows = rows.where((F.size("a") > 0) & (F.size("b") > 0))
    scored = S.two_sample(rows, F.col("algorithm"), F.col("a"), F.col("b"))
    return scored.select("group_id", "method", "iteration", "statistic")


def _scored(ready: DataFrame, options: Drift) -> DataFrame:
    """One row per key with all statistics of its null."""
    made = resampling.null_batches(options.resamples, options.seed)
    return ready.select("group_id", "algorithm", "method", "history").mapInArrow(made, "group_id string, method string, null_size long, statistics array<double>")


def null_statistics(chosen: DataFrame, options: Drift = Drift()) -> DataFrame:
    """The statistic between parts of a key's own history: `group_id, method, iteration, statistic`."""
    ready = _ready(chosen, options)
    long = lambda rows: rows.select("group_id", "method", F.posexplode("statistics").alias("iteration", "statistic"))
    if not (registry.STATISTICS or registry.NULLS):
        return long(_scored(ready, options))
    return long(_scored(ready.where(~_registered()), options)).unionByName(_expressed(ready.where(_registered()), options))


def key_nulls(chosen: DataFrame, options: Drift = Drift()) -> DataFrame:
    """`null_statistics` with a row per key: `group_id, method, null_size, statistics`."""
    ready = _ready(chosen, options)
    if not (registry.STATISTICS or registry.NULLS):
        return _scored(ready, options)
    return _scored(ready.where(~_registered()), options).unionByName(_gathered(_expressed(ready.where(_registered()), options)))


def _gathered(nulls: DataFrame) -> DataFrame:
    return nulls.groupBy("group_id").agg(
        F.first("method").alias("method"), F.count(F.lit(1)).alias("null_size"),
        F.collect_list("statistic").alias("statistics"),  # at most `resamples` values
    )


def thresholds(chosen: DataFrame, nulls: DataFrame, options: Drift = Drift()) -> DataFrame:
    """`group_id, method, threshold, null_size`; an empty null gives 0, which any positive statistic fails.

    `nulls` has a row per key (`key_nulls`) or per statistic (`null_statistics`).
    """
    per_key = nulls if "statistics" in nulls.columns else _gathered(nulls)
    read = resampling.threshold_batches(options.percentile, options.kde_draws, options.seed)
    per_key = per_key.select("group_id", "method", "null_size", "statistics").mapInArrow(read, "group_id string, null_size long, read double")
    joined = chosen.select("group_id", threshold_method(F.col("sample_size"), options).alias("method")).join(per_key, "group_id", "left")
    return joined.select(
        "group_id", "method",
        F.greatest(F.lit(0.0), F.coalesce("read", F.lit(0.0))).alias("threshold"),
        F.coalesce("null_size", F.lit(0)).cast("long").alias("null_size"),
    )


def drift_verdicts(chosen: DataFrame, limits: DataFrame, current: DataFrame) -> DataFrame:
    """`statistic <= threshold` per (group, model), with the ordered stage trail.

    A group without history or a forecast without values gives an error row.
    """
    both = current.join(chosen.join(limits, "group_id"), "group_id", "left")
    usable = (F.size("history") > 0) & (F.size("current") > 0)
    scored = S.two_sample(both.where(F.coalesce(usable, F.lit(False))), F.col("algorithm"), F.col("history"), F.col("current"))
    passed = F.col("statistic") <= F.col("threshold")
    stage = lambda name, detail: F.struct(F.lit(name).alias("stage"), detail.alias("detail"))
    detail = F.format_string(
        "%s statistic %.6f %s threshold %.6f (%s).", F.col("algorithm"), F.col("statistic"),
        F.when(passed, "<=").otherwise(">"), F.col("threshold"), F.col("method"),
    )
    trail = F.array(
        stage("Dynamic Drift Selection", F.col("algorithm")),
        stage("Threshold Validation", F.format_string("%s %.6f", F.col("method"), F.col("threshold"))),
        stage("Drift Validation", detail),
    )
    columns = ["group_id", "model_name", "algorithm", "method", "statistic", "threshold"]
    good = scored.select(*columns, passed.alias("passed"), detail.alias("detail"), trail.alias("trail"), F.lit(None).cast("string").alias("error"))
    bad = both.where(~F.coalesce(usable, F.lit(False))).select(
        "group_id", "model_name", "algorithm", "method", F.lit(None).cast("double").alias("statistic"), "threshold",
        F.lit(False).alias("passed"), F.lit("No finite values to compare.").alias("detail"),
        F.lit(None).cast(good.schema["trail"].dataType).alias("trail"), F.lit("No finite values to compare.").alias("error"),
    )
    return good.unionByName(bad)
