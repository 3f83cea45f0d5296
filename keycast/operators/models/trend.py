"""Linear trend plus calendar-month effects with normal 95% bounds; with regressors, least squares of all three together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96
RIDGE = 1e-11


def solved(matrix: Column) -> Column:
    """Solution of a system given as rows [coefficients..., right side], by elimination; an unknown without a pivot is 0.

    For normal equations: symmetric, not negative. One expression whatever the size.
    """
    size = F.size(matrix)

    def eliminate(rows: Column, k: Column) -> Column:
        lead = F.get(rows, k)
        pivot = F.get(lead, k)
        usable = pivot > 0
        scaled = F.transform(lead, lambda v: F.when(usable, v / pivot).otherwise(F.lit(0.0)))
        other = lambda row: F.zip_with(row, scaled, lambda v, s: v - F.get(row, k) * s)
        return F.transform(rows, lambda row, i: F.when(i == k, scaled).otherwise(F.when(usable, other(row)).otherwise(row)))

    done = F.aggregate(F.sequence(F.lit(0), size - 1), matrix, eliminate)
    return F.transform(done, lambda row: F.element_at(row, -1))


def _terms(regressors: list[str]) -> list[Column]:
    """The design: one, time, twelve months, regressors."""
    months = [(F.col("_month") == m).cast("double") for m in range(1, 13)]
    return [F.lit(1.0), F.col("_at"), *months, *[F.col(f"_x{k}") for k in range(len(regressors))]]


def _prepared(frame: DataFrame, regressors: list[str]) -> DataFrame:
    """Frame rows with the design's columns; a missing regressor counts as its mean over the fold's training rows."""
    fold = Window.partitionBy("group_id", "fold")
    out = frame.withColumn("_month", F.month("ds")).withColumn("_at", F.col("t").cast("double"))
    for k, regressor in enumerate(regressors):
        value = F.col(regressor).cast("double")
        mean = F.avg(F.when(F.col("part") == "train", value)).over(fold)
        out = out.withColumn(f"_x{k}", F.coalesce(value, mean, F.lit(0.0)))
    return out


def joint_fit(frame: DataFrame, regressors: list[str]) -> DataFrame:
    """Per (group, fold): `beta` and `sigma` of least squares over trend, months and regressors together.

    Only sums of products are gathered per fold, whose number the design sets;
    they make the normal equations, solved as one array expression. Months and
    regressors carry a penalty of a 10**11th of their own sum of squares: nothing where
    the data decide, and where they do not (a fold of a single year, a regressor without
    spread) it leaves the trend to the line and the rest to the months.
    """
    prepared = _prepared(frame, regressors).where("part = 'train' AND train_y IS NOT NULL")
    terms = [*_terms(regressors), F.col("train_y")]
    size = len(terms) - 1
    pairs = [(a, b) for a in range(len(terms)) for b in range(a, len(terms)) if not (2 <= a < b < 14)]  # two months never meet
    sums = prepared.groupBy("group_id", "fold").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(terms[a] * terms[b]).alias(f"_s{a}_{b}") for a, b in pairs])

    def entry(a: int, b: int) -> Column:
        a, b = min(a, b), max(a, b)
        value = F.col(f"_s{a}_{b}") if (a, b) in known else F.lit(0.0)
        return value * (1 + RIDGE) if a == b and a >= 2 else value

    known = set(pairs)
    matrix = F.array(*[F.array(*[entry(a, b) for b in range(size + 1)]) for a in range(size)])
    rows = sums.withColumn("_matrix", matrix).withColumn("beta", solved(F.col("_matrix")))
    # Squares that the fit leaves: y'y - beta'X'y, since the fit solves the normal equations.
    explained = F.aggregate(F.zip_with("beta", F.col("_matrix"), lambda b, row: b * F.element_at(row, -1)), F.lit(0.0), lambda total, v: total + v)
    left = F.greatest(F.lit(0.0), F.col(f"_s{size}_{size}") - explained)
    return rows.select("group_id", "fold", "beta", F.when(F.col("_n") > 1, F.sqrt(left / (F.col("_n") - 1))).otherwise(F.lit(0.0)).alias("sigma"))


def with_regressors(frame: DataFrame, regressors: list[str]) -> DataFrame:
    """Frame rows with `fit` and `sigma` of `joint_fit`."""
    rows = _prepared(frame, regressors).join(joint_fit(frame, regressors), ["group_id", "fold"])
    fit = F.aggregate(F.zip_with("beta", F.array(*_terms(regressors)), lambda b, x: b * x), F.lit(0.0), lambda total, v: total + v)
    return rows.withColumn("fit", fit).drop("beta", "_at", "_month", *[f"_x{k}" for k in range(len(regressors))])


def fitted(frame: DataFrame, regressors: list[str] = ()) -> DataFrame:
    """Frame rows with the fit of their own fold. Without regressors by windows only: test rows read the fit in place."""
    if regressors:
        return with_regressors(frame, list(regressors))
    fold = Window.partitionBy("group_id", "fold")
    month = Window.partitionBy("group_id", "fold", "_month")
    at = F.col("t").cast("double")
    line = F.coalesce(F.regr_slope("train_y", at).over(fold), F.lit(0.0))
    base = F.coalesce(F.regr_intercept("train_y", at).over(fold), F.avg("train_y").over(fold))
    out = frame.withColumn("_month", F.month("ds")).withColumn("slope", line).withColumn("intercept", base)
    out = out.withColumn("_rest", F.col("train_y") - (F.col("intercept") + F.col("slope") * at))
    out = out.withColumn("season", F.coalesce(F.avg("_rest").over(month), F.lit(0.0)))
    out = out.withColumn("sigma", F.coalesce(F.stddev_samp(F.col("_rest") - F.col("season")).over(fold), F.lit(0.0)))
    out = out.withColumn("fit", F.col("intercept") + F.col("slope") * at + F.col("season"))
    return out


def predict(frame: DataFrame, regressors: list[str] = ()) -> DataFrame:
    rows = fitted(frame, regressors).where((F.col("part") == "test") & F.col("fit").isNotNull())
    return rows.select(
        "group_id", F.lit("trend_seasonal").alias("model_name"), "fold", "step", "ds", F.col("y").alias("actual"),
        F.col("fit").alias("value"),
        (F.col("fit") - Z95 * F.col("sigma")).alias("lower"),
        (F.col("fit") + Z95 * F.col("sigma")).alias("upper"),
    )
