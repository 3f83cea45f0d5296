"""Backtest folds and the forward horizon as extra key columns of one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import Backtest
from keycast.operators.series import future_day

FORWARD = -1  # fold number of the full-history fit


def fold_count(n: Column, options: Backtest = Backtest()) -> Column:
    step = options.step or options.horizon
    room = n - options.min_train - options.horizon
    fit = F.floor(room / step) + 1
    kept = fit if options.max_folds is None else F.least(F.lit(options.max_folds), fit)
    return F.when(room >= 0, kept).otherwise(0).cast("int")


def _folds(n: Column, options: Backtest) -> Column:
    """Array of (fold, start, end) for a series of n rows; end is exclusive."""
    step = options.step or options.horizon
    size = options.window or options.min_train
    count = fold_count(n, options)

    def bounds(k: Column) -> Column:
        if options.newest_first:
            end = n - options.horizon - (count - 1 - k) * step
        else:
            end = F.lit(options.min_train) + k * step
        start = F.lit(0) if options.strategy == "expanding" else F.greatest(F.lit(0), end - size)
        return F.struct(k.cast("int").alias("fold"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    none = F.array().cast("array<struct<fold:int,start:int,end:int>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), bounds)).otherwise(none)


def fold_table(facts: DataFrame, options: Backtest = Backtest()) -> DataFrame:
    """`group_id, fold, train_start, train_end` from `group_id, n`."""
    return facts.select("group_id", F.inline(_folds(F.col("n"), options))).select(
        "group_id", "fold", F.col("start").alias("train_start"), F.col("end").alias("train_end")
    )


def frame(series: DataFrame, options: Backtest = Backtest(), horizon: int = 12, regressors: list[str] = ()) -> DataFrame:
    """Every row each fold trains on or is tested on, plus the future rows of the full fit.

    Fold membership follows from a row's own position, so slicing needs no
    join: rows are expanded in place, and the last row of a series also emits
    its future steps. The group partitioning of `series` is kept throughout.
    Regressors ride along: test rows carry their own values, future rows the
    last observed ones. Columns: group_id, n, fold, part (train|test), step, t,
    ds, y, train_y and the regressors.
    """
    group = Window.partitionBy("group_id")
    spaced = series.withColumn("_gap", F.datediff("ds", F.lag("ds").over(group.orderBy("t"))))
    median = F.median("_gap").over(group)
    spaced = spaced.withColumn("_days", F.when(median.isNull() | (median <= 0), F.lit(30.0)).otherwise(median.cast("double")))
    t, n, y, ds = F.col("t"), F.col("n"), F.col("y"), F.col("ds")

    def place(fold, part, step, at, day, value):
        return F.struct(
            fold.cast("int").alias("fold"), part.alias("part"), step.cast("int").alias("step"),
            at.cast("int").alias("t"), day.alias("ds"), value.cast("double").alias("y"),
        )

    inside = F.filter(_folds(n, options), lambda f: (t >= f["start"]) & (t < f["end"] + options.horizon))
    backtest = F.transform(
        inside,
        lambda f: place(
            f["fold"],
            F.when(t < f["end"], F.lit("train")).otherwise(F.lit("test")),
            F.when(t >= f["end"], t - f["end"] + 1),
            t, ds, y,
        ),
    )
    own = F.array(place(F.lit(FORWARD), F.lit("train"), F.lit(None), t, ds, y))
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda s: place(F.lit(FORWARD), F.lit("test"), s, t + s, future_day(ds, F.col("_days"), s), F.lit(None)),
    )
    rows = F.when(t == n - 1, F.concat(backtest, own, ahead)).otherwise(F.concat(backtest, own))
    out = spaced.select("group_id", "n", *regressors, F.inline(rows))
    return out.withColumn("train_y", F.when(F.col("part") == "train", F.col("y")))
