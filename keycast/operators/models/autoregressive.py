"""Autoregression with order search: p in 0..2, d in 0..1, chosen by AIC.

Least squares needs only means and co-moments of a series against its own
lags, so every order of every key and fold is fitted by one aggregate and a
closed-form solve. All orders share the sample left after three lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.functions.samples import pinned
from keycast.operators.models.naive import tests

Z95 = 1.96
TINY = 1e-9


def _moments(frame: DataFrame) -> DataFrame:
    fold = Window.partitionBy("group_id", "fold")
    by_time = fold.orderBy("t")
    rows = frame.withColumn("_level", F.avg("train_y").over(fold)).withColumn("y0", F.col("train_y") - F.col("_level"))
    for k in (1, 2, 3):
        rows = rows.withColumn(f"y{k}", F.lag("y0", k).over(by_time))
    whole = F.col("y0").isNotNull() & F.col("y3").isNotNull()
    for k in (0, 1, 2):
        rows = rows.withColumn(f"u{k}", F.when(whole, F.col(f"y{k}")))
        rows = rows.withColumn(f"w{k}", F.when(whole, F.col(f"y{k}") - F.col(f"y{k + 1}")))
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    last = lambda k: F.max_by(F.col(f"y{k}"), F.when(F.col("y0").isNotNull(), F.col("t")))
    return rows.groupBy("group_id", "fold").agg(
        F.max("_level").alias("level"),
        F.count("u0").cast("double").alias("m"),
        *[F.avg(f"u{k}").alias(f"a{k}") for k in (0, 1, 2)],
        *[F.covar_pop(f"u{i}", f"u{j}").alias(f"v{i}{j}") for i, j in pairs],
        *[F.avg(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"s{i}{j}") for i, j in pairs],
        *[last(k).alias(f"l{k + 1}") for k in (0, 1, 2)],
        tests(),
    )


def _order(p: int, d: int) -> Column:
    """(aic, p, d, a, c1, c2, c3, sigma2): one fitted order in level form, null if unusable."""
    c = lambda i, j: F.col(f"{'v' if d == 0 else 's'}{i}{j}")
    zero = F.lit(0.0)
    if p == 0:
        b1, b2, ok = zero, zero, F.lit(True)
    elif p == 1:
        b1, b2 = c(0, 1) / F.nullif(c(1, 1), F.lit(0.0)), zero
        ok = F.abs(b1) < 1
    else:
        det = F.nullif(c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2), F.lit(0.0))
        b1 = (c(0, 1) * c(2, 2) - c(0, 2) * c(1, 2)) / det
        b2 = (c(0, 2) * c(1, 1) - c(0, 1) * c(1, 2)) / det
        ok = (F.abs(b2) < 1) & (b2 + b1 < 1) & (b2 - b1 < 1)
    sigma2 = F.greatest(c(0, 0) - b1 * c(0, 1) - b2 * c(0, 2), F.lit(TINY))
    terms = p + (1 if d == 0 else 0)
    aic = F.col("m") * F.ln(sigma2) + 2 * (terms + 1)
    if d == 0:
        a, c1, c2, c3 = F.col("a0") - b1 * F.col("a1") - b2 * F.col("a2"), b1, b2, zero
    else:
        a, c1, c2, c3 = zero, 1 + b1, b2 - b1, -b2
    fit = F.struct(
        aic.alias("aic"), F.lit(p).alias("p"), F.lit(d).alias("d"), a.alias("a"),
        c1.alias("c1"), c2.alias("c2"), c3.alias("c3"), sigma2.alias("sigma2"),
    )
    return F.when(ok & aic.isNotNull() & (F.col("m") > terms + 1), fit)


def fits(frame: DataFrame) -> DataFrame:
    """One row per (group, fold): the order with the smallest AIC (then p, then d)."""
    orders = F.array_compact(F.array(*[_order(p, d) for p in (0, 1, 2) for d in (0, 1)]))
    chosen = pinned(_moments(frame), fit=F.array_min(orders))
    return chosen.where(F.col("fit").isNotNull()).select(
        "group_id", "fold", "level", "l1", "l2", "l3", "tests", "m", F.col("fit.*")
    )


def predict(frame: DataFrame) -> DataFrame:
    step = lambda acc, constant: (
        constant + F.col("c1") * F.element_at(acc, -1) + F.col("c2") * F.element_at(acc, -2) + F.col("c3") * F.element_at(acc, -3)
    )
    grow = lambda constant: lambda acc, _: F.concat(acc, F.array(step(acc, constant)))
    ahead = F.sequence(F.lit(1), F.array_max(F.transform("tests", lambda r: r["step"])))
    paths = pinned(
        fits(frame).where(F.size("tests") > 0),
        path=F.aggregate(ahead, F.array("l3", "l2", "l1"), grow(F.col("a"))),
        psi=F.aggregate(ahead, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), grow(F.lit(0.0))),
    )
    steps = paths.select("group_id", "fold", "level", "sigma2", "path", "psi", F.inline("tests"))
    value = F.col("level") + F.element_at("path", F.col("step") + 3)
    weights = F.slice("psi", F.lit(3), F.col("step"))
    spread = Z95 * F.sqrt(F.col("sigma2") * F.aggregate(weights, F.lit(0.0), lambda s, w: s + w * w))
    return steps.select(
        "group_id", F.lit("autoregressive").alias("model_name"), "fold", "step", "ds", "actual",
        value.alias("value"), (value - spread).alias("lower"), (value + spread).alias("upper"),
    )
