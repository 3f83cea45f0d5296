"""Importance vectors: how plausible and how repeatable a model's drivers are.

Vectors are long rows `group_id, model_name, vector_id, feature, weight`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import Importance
from keycast.operators.ranking import weighted_mean

PAIR = ["group_id", "model_name"]


def normalised(vectors: DataFrame) -> DataFrame:
    """Weights of each vector scaled to sum to one (left alone when they sum to nothing)."""
    total = F.sum("weight").over(Window.partitionBy(*PAIR, "vector_id"))
    return vectors.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def segment(t: Column, n: Column, options: Importance = Importance()) -> Column:
    """Chronological segment of a row; null when the series is too short to cut."""
    size = F.floor(n / options.segments)
    enough = (F.lit(options.segments) >= 2) & (n >= options.min_rows * 2) & (size >= options.min_rows)
    return F.when(enough, F.least(F.floor(t / F.nullif(size, F.lit(0))), F.lit(options.segments - 1))).cast("int")


def in_tail(t: Column, n: Column, fraction: float, options: Importance = Importance()) -> Column:
    """Whether a row belongs to the newest `fraction` of its series."""
    return t >= n - F.greatest(F.lit(options.min_rows), F.floor(n * F.lit(fraction)))


def feature_correlations(matrix: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Correlation of every feature with the target, per key: one aggregate, then one row per feature."""
    summed = matrix.groupBy(*keys).agg(*[F.corr(f, target).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])
    return summed.select(*keys, F.inline(pairs)).withColumn(
        "correlation", F.when(~F.isnan("correlation"), F.col("correlation"))
    )


def plausibility(point: DataFrame, correlations: DataFrame, options: Importance = Importance()) -> DataFrame:
    """Share of a model's weight on features that correlate with the target at all."""
    by = [c for c in ("group_id", "model_name") if c in correlations.columns]
    joined = point.join(correlations, [*by, "feature"], "left")
    good = F.sum(F.when(F.abs("correlation") >= options.min_correlation, F.col("weight")).otherwise(F.lit(0.0)))
    share = good / F.nullif(F.sum("weight"), F.lit(0.0))
    return joined.groupBy(*PAIR).agg(F.coalesce(share, F.lit(1.0)).alias("plausibility"))


def average_rank(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0


def completed(vectors: DataFrame) -> DataFrame:
    """Vectors over the union of their pair's features; an absent feature weighs 0."""
    maps = vectors.groupBy(*PAIR, "vector_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("_w"))
    names = F.array_distinct(F.flatten(F.collect_list(F.map_keys("_w")).over(Window.partitionBy(*PAIR))))
    grid = maps.withColumn("_names", names).select(*PAIR, "vector_id", "_w", F.explode("_names").alias("feature"))
    return grid.select(*PAIR, "vector_id", "feature", F.coalesce(F.try_element_at("_w", F.col("feature")), F.lit(0.0)).alias("weight"))


def consistency(vectors: DataFrame, name: str = "consistency") -> DataFrame:
    """Mean Spearman correlation over all vector pairs of a (group, model), mapped to 0..1.

    Pairs are never formed: with unit rank vectors z, the sum over pairs is
    (|sum z|^2 - m) / 2. Flat vectors only pair, at 1, with equal flat ones.
    """
    by = [*PAIR, "vector_id"]
    ranked = completed(vectors).withColumn("_rank", average_rank("weight", by))
    w = Window.partitionBy(*by)
    ranked = ranked.withColumn("_c", F.col("_rank") - F.avg("_rank").over(w)).withColumn("_norm", F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(w)))
    unit = ranked.withColumn("_z", F.col("_c") / F.nullif(F.col("_norm"), F.lit(0.0)))
    per_feature = unit.groupBy(*PAIR, "feature").agg(
        F.coalesce(F.sum("_z"), F.lit(0.0)).alias("_s"), F.count("_z").alias("_m"), F.count(F.lit(1)).alias("_vectors"),
        # One entry per flat vector: at most the handful of vectors a pair has.
        F.collect_list(F.when(F.col("_norm") == 0, F.round("weight", 8))).alias("_flat"),
    )
    shaped = per_feature.groupBy(*PAIR).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_square"), F.max("_m").alias("_m"), F.max("_vectors").alias("_vectors"),
        F.count(F.lit(1)).alias("_features"), F.first("_flat").alias("_flat"),
    )
    same = F.aggregate("_flat", F.lit(0.0), lambda total, x: total + (F.size(F.filter("_flat", lambda y: y == x)) - 1) / 2.0)
    pairs = F.col("_m") * (F.col("_m") - 1) / 2
    shaped = shaped.withColumn("_same", same)
    mean = ((F.col("_square") - F.col("_m")) / 2 + F.col("_same")) / F.nullif(pairs + F.col("_same"), F.lit(0.0))
    mapped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + 1) / 2))
    value = F.when(F.col("_vectors") < 2, F.lit(None)).when(F.col("_features") < 2, F.lit(1.0)).otherwise(mapped)
    return shaped.select(*PAIR, value.cast("double").alias(name))


def dominant(point: DataFrame, vectors: DataFrame, options: Importance = Importance()) -> DataFrame:
    """Leading feature, how often other vectors agree, and features whose share moved.

    Equal weights resolve to the alphabetically first feature.
    """
    lead = lambda: F.min_by("feature", F.struct(-F.col("weight"), F.col("feature")))
    main = point.groupBy(*PAIR).agg(lead().alias("dominant_feature"))
    others = vectors.groupBy(*PAIR, "vector_id").agg(lead().alias("_lead"))
    agreed = others.join(main, PAIR).groupBy(*PAIR).agg(
        F.avg((F.col("_lead") == F.col("dominant_feature")).cast("double")).alias("dominant_consistency")
    )
    ids = vectors.select(*PAIR, "vector_id").distinct()
    grid = point.select(*PAIR, "feature", F.col("weight").alias("_share")).join(ids, PAIR)
    moved = grid.join(vectors, [*PAIR, "vector_id", "feature"], "left").where(
        F.abs(F.coalesce("weight", F.lit(0.0)) - F.col("_share")) > options.max_share_move
    )
    changed = moved.groupBy(*PAIR).agg(F.array_sort(F.collect_set("feature")).alias("significant_changes"))
    return main.join(agreed, PAIR, "left").join(changed, PAIR, "left").withColumn(
        "significant_changes", F.coalesce("significant_changes", F.array().cast("array<string>"))
    )


def composite(window: Column, plausible: Column, horizon: Column, options: Importance = Importance()) -> Column:
    """Weighted mean of the parts that could be measured."""
    return weighted_mean([(window, options.stability), (plausible, options.plausibility), (horizon, options.horizon)])


def assemble(point: DataFrame, correlations: DataFrame, window_vectors: DataFrame, horizon_vectors: DataFrame, options: Importance = Importance(), method: str = "native_importance") -> DataFrame:
    """One record per (group, model) that has a point vector."""
    joined = (
        plausibility(point, correlations, options)
        .join(consistency(window_vectors, "window_stability"), PAIR, "left")
        .join(consistency(horizon_vectors, "horizon_stability"), PAIR, "left")
        .join(dominant(point, window_vectors.unionByName(horizon_vectors), options), PAIR, "left")
    )
    score = composite(F.col("window_stability"), F.col("plausibility"), F.col("horizon_stability"), options)
    return joined.withColumn("importance_score", score).withColumn("method", F.lit(method))


def for_survivors(survivors: DataFrame, records: DataFrame, options: Importance = Importance()) -> DataFrame:
    """One record per surviving pair; a pair with nothing to permute gets the neutral record."""
    joined = survivors.select(*PAIR).join(records, PAIR, "left")
    full = F.lit(options.fallback_score)
    absent = F.col("method").isNull()
    return joined.select(
        *PAIR,
        F.coalesce("method", F.lit("univariate_fallback")).alias("method"),
        F.when(absent, F.lit(1.0)).otherwise(F.col("window_stability")).alias("window_stability"),
        F.when(absent, F.lit(1.0)).otherwise(F.col("horizon_stability")).alias("horizon_stability"),
        F.coalesce("plausibility", F.lit(1.0)).alias("plausibility"),
        "dominant_feature",
        F.coalesce("importance_score", full).alias("importance_score"),
    )


def top_drivers(point: DataFrame, limit: int = 8) -> DataFrame:
    """The strongest features of each (group, model) by absolute weight."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc(F.abs("weight")), "feature")
    return point.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("importance", F.round("weight", 4))
