"""Lag, rolling, calendar and index features, all strictly from earlier rows of the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import CALENDAR_FEATURES, LAGS, MIN_TRAINING_ROWS, ROLLING_WINDOWS


def fits(n: Column, span: int, spans: tuple[int, ...]) -> Column:
    """Whether a series of `n` rows can support a span; lag 1 stays when none can."""
    usable = n - F.lit(span) >= MIN_TRAINING_ROWS
    if span == 1:
        any_fits = F.lit(False)
        for s in spans:
            any_fits = any_fits | (n - F.lit(s) >= MIN_TRAINING_ROWS)
        return usable | ~any_fits
    return usable


def derived(df: DataFrame, keys: list[str], order: list[str], value: str, date: str, spec: dict | None = None) -> DataFrame:
    """Original rows plus the chosen features; one shared window, one sort."""
    spec = spec or {"lags": LAGS, "rolling_windows": ROLLING_WINDOWS, "calendar_features": CALENDAR_FEATURES}
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df
    for n in spec["lags"]:
        out = out.withColumn(f"lag_{n}", F.lag(value, n).over(w))
    for n in spec["rolling_windows"]:
        frame = w.rowsBetween(-n, -1)
        full = F.count(value).over(frame) == n
        out = out.withColumn(f"rolling_mean_{n}", F.when(full, F.avg(value).over(frame)))
    if "month" in spec["calendar_features"]:
        out = out.withColumn("month", F.month(date))
    if "quarter" in spec["calendar_features"]:
        out = out.withColumn("quarter", F.quarter(date))
    return out


def feature_names(spec: dict | None = None) -> list[str]:
    spec = spec or {"lags": LAGS, "rolling_windows": ROLLING_WINDOWS, "calendar_features": CALENDAR_FEATURES}
    return (
        ["time_index"]
        + [f"lag_{n}" for n in spec["lags"]]
        + [f"rolling_mean_{n}" for n in spec["rolling_windows"]]
        + list(spec["calendar_features"])
    )


def design_matrix(rows: DataFrame, keys: list[str], spec: dict | None = None, extra: list[str] = (), difference: bool = True) -> DataFrame:
    """Training rows of every (key…): features, `label`, and only complete cases.

    Spans a series is too short for are left out of its completeness test and
    set to null. A series with no complete row at all keeps all its rows.
    """
    spec = spec or {"lags": list(LAGS), "rolling_windows": list(ROLLING_WINDOWS), "calendar_features": list(CALENDAR_FEATURES)}
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("t")
    size = F.count(F.lit(1)).over(whole)
    out = derived(rows.withColumn("_n", size), keys, ["t"], "y", "ds", spec)
    out = out.withColumn("time_index", (F.row_number().over(w) - 1).cast("double"))
    label = F.col("y") - F.lag("y", 1).over(w) if difference else F.col("y")
    out = out.withColumn("label", label)
    complete = F.col("label").isNotNull()
    for kind, spans in (("lag", tuple(spec["lags"])), ("rolling_mean", tuple(spec["rolling_windows"]))):
        for n in spans:
            name = f"{kind}_{n}"
            keep = fits(F.col("_n"), n, spans)
            out = out.withColumn(name, F.when(keep, F.col(name)))
            complete = complete & (~keep | F.col(name).isNotNull())
    for name in extra:
        complete = complete & F.col(name).isNotNull()
    out = out.withColumn("_complete", complete)
    out = out.withColumn("_some", F.max(F.col("_complete").cast("int")).over(whole))
    return out.where(F.col("_complete") | (F.col("_some") == 0)).drop("_complete", "_some", "_n")
