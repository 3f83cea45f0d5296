"""Composite ranking of the surviving models of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import Ranking
from keycast.operators.metrics import METRICS

PAIR = ["group_id", "model_name"]


def inverse_scaled(value: Column, by: list[str]) -> Column:
    """1 for the smallest value of a group, 0 for the largest; 1 for all when equal; null stays null."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = 1 - (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(value.isNotNull(), F.coalesce(scaled, F.lit(1.0)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that exist; null when none does."""
    total = weight = F.lit(0.0)
    for value, share in parts:
        total = total + F.coalesce(value * share, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(float(share))).otherwise(F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def backtest_scores(scores: DataFrame, options: Ranking = Ranking()) -> DataFrame:
    """Accuracy score in 0..1 per (group, model) from overall metrics."""
    parts = [(inverse_scaled(F.col(m), ["group_id"]), w) for m, w in options.metric_weights]
    out = scores
    for (column, _), name in zip(parts, [m for m, _ in options.metric_weights]):
        out = out.withColumn(f"{name}_score", column)
    scored = weighted_mean([(F.col(f"{m}_score"), w) for m, w in options.metric_weights])
    return out.withColumn("backtest_score", F.coalesce(scored, F.lit(options.neutral)))


def stability_measures(forecasts: DataFrame) -> DataFrame:
    """Relative spread, mean absolute second difference and interval width of each forecast."""
    w = Window.partitionBy(*PAIR).orderBy("step")
    bend = F.col("value") - 2 * F.lag("value", 1).over(w) + F.lag("value", 2).over(w)
    scale = F.coalesce(F.nullif(F.abs(F.avg("value")), F.lit(0.0)), F.lit(1.0))
    finite_rows = forecasts.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite_rows.withColumn("bend", bend).groupBy(*PAIR).agg(
        (F.stddev_pop("value") / scale).alias("variance"),
        F.coalesce(F.avg(F.abs("bend")) / scale, F.lit(0.0)).alias("smoothness"),
        (F.avg(F.col("upper") - F.col("lower")) / scale).alias("interval_width"),
    )


def stability_scores(measures: DataFrame, options: Ranking = Ranking()) -> DataFrame:
    by = ["group_id"]
    out = (
        measures.withColumn("variance_score", inverse_scaled(F.col("variance"), by))
        .withColumn("smoothness_score", inverse_scaled(F.col("smoothness"), by))
        .withColumn("interval_score", F.coalesce(inverse_scaled(F.col("interval_width"), by), F.lit(options.no_interval)))
    )
    score = weighted_mean([
        (F.col("variance_score"), options.variance),
        (F.col("smoothness_score"), options.smoothness),
        (F.col("interval_score"), options.interval),
    ])
    return out.withColumn("stability_score", score)


def rank_models(survivors: DataFrame, forecasts: DataFrame, importance: DataFrame | None = None, options: Ranking = Ranking()) -> DataFrame:
    """Backtest, stability and importance scores, their composite and both ranks.

    `survivors` carries the overall metrics and `model_position`; ties follow
    registry order. `importance` is `group_id, model_name, importance_score`.
    """
    scored = backtest_scores(survivors.select(*PAIR, "model_position", *METRICS), options)
    stable = stability_scores(stability_measures(forecasts.join(survivors.select(*PAIR), PAIR, "left_semi")), options)
    joined = scored.join(stable, PAIR)
    if importance is None:
        joined = joined.withColumn("importance_score", F.lit(options.neutral))
    else:
        joined = joined.join(importance.select(*PAIR, "importance_score"), PAIR, "left").fillna({"importance_score": options.neutral})
    composite = weighted_mean([
        (F.col("backtest_score"), options.backtest),
        (F.col("stability_score"), options.stability),
        (F.col("importance_score"), options.importance),
    ])
    ranked = joined.withColumn("composite_score", composite)
    group = Window.partitionBy("group_id")
    # Scores are rounded for ordering so that ties in exact arithmetic stay ties.
    place = lambda c: F.row_number().over(group.orderBy(F.desc(F.round(c, 12)), "model_position"))
    return ranked.withColumn("backtest_rank", place("backtest_score")).withColumn("final_rank", place("composite_score"))


def top_candidates(groups: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best model per group; groups without a ranked model keep a null."""
    best = ranked.where("final_rank = 1").select("group_id", "model_name", "composite_score")
    return groups.select("group_id").join(best, "group_id", "left")
