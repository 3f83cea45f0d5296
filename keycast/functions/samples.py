"""Statistics over two bounded samples held as array columns.

A reference window holds at most a few hundred months, so a sample fits in a
row and every statistic is a projection: no shuffle, no extra key columns.
Inputs must be plain columns (see `pinned`), since a lambda would otherwise
recompute the array expression for every element.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast import registry

PSI = "population_stability_index"
KS = "kolmogorov_smirnov"
WASSERSTEIN = "wasserstein_distance"
JS = "jensen_shannon_divergence"
ALGORITHMS = (PSI, KS, WASSERSTEIN, JS)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns evaluated once per row.

    A generator keeps the optimizer from folding the expression into later
    lambdas, where it would run once per array element.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(packed))


def moments(values: Column) -> Column:
    """(n, mean, m2) of an array in one pass."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(values, zero, add)


def std_pop(values: Column) -> Column:
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda s, x: F.struct(
            (s["n"] + 1).alias("n"),
            (s["mean"] + (x - s["mean"]) / (s["n"] + 1)).alias("mean"),
            (s["m2"] + (x - s["mean"]) * (x - s["mean"]) * s["n"] / (s["n"] + 1)).alias("m2"),
        ),
        lambda s: F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0.0))),
    )


def quantile(ordered: Column, p: float | Column) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    at = (F.size(ordered) - 1) * (F.lit(p) if isinstance(p, float) else p)
    low = F.element_at(ordered, F.floor(at).cast("int") + 1)
    high = F.element_at(ordered, F.ceil(at).cast("int") + 1)
    return low + (high - low) * (at - F.floor(at))


def _cdf_gap(a: str, b: str) -> Column:
    """(best, area): largest CDF gap and area between CDFs, both times n_a * n_b.

    Counts are whole numbers, so equal gaps compare equal whatever the order
    of summation; a threshold read off the same lattice never loses a tie.
    """
    up, down = F.size(b).cast("long"), F.size(a).cast("long")
    tagged = F.sort_array(F.concat(
        F.transform(a, lambda x: F.struct(x.alias("x"), up.alias("w"))),
        F.transform(b, lambda x: F.struct(x.alias("x"), (-down).alias("w"))),
    ))
    zero = F.struct(
        F.element_at(tagged, 1)["x"].alias("x"), F.lit(0).cast("long").alias("cum"),
        F.lit(0).cast("long").alias("best"), F.lit(0.0).alias("area"),
    )

    def step(s: Column, e: Column) -> Column:
        moved = e["x"] != s["x"]
        gap = F.abs(s["cum"])
        return F.struct(
            e["x"].alias("x"),
            (s["cum"] + e["w"]).alias("cum"),
            F.when(moved, F.greatest(s["best"], gap)).otherwise(s["best"]).alias("best"),
            (s["area"] + gap * (e["x"] - s["x"])).alias("area"),
        )

    return F.aggregate(tagged, zero, step)


def kolmogorov_smirnov(a: str, b: str) -> Column:
    return _cdf_gap(a, b)["best"] / (F.size(a).cast("double") * F.size(b))


def wasserstein(a: str, b: str) -> Column:
    """Wasserstein-1 over the reference's population spread (raw when it has none)."""
    raw = _cdf_gap(a, b)["area"] / (F.size(a).cast("double") * F.size(b))
    spread = std_pop(F.col(a))
    return F.when(spread > 0, raw / spread).otherwise(raw)


def psi_edges(ordered: Column, bins: int = 10) -> Column:
    """Distinct decile edges; with fewer than three, minimum, median and maximum."""
    deciles = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(bins)), lambda i: quantile(ordered, i.cast("double") / bins)
    ))
    plain = F.array_distinct(F.array(quantile(ordered, 0.0), quantile(ordered, 0.5), quantile(ordered, 1.0)))
    return F.when(F.size(deciles) < 3, plain).otherwise(deciles)


def _running(values: Column, inner: Column) -> Column:
    """Counts below each inner edge, with 0 in front and the total behind."""
    below = F.transform(inner, lambda e: F.size(F.filter(values, lambda x: x < e)))
    return F.concat(F.array(F.lit(0)), below, F.array(F.size(values)))


def _bins(a: str, b: str, inner: Column) -> Column:
    return F.zip_with(_running(F.col(a), inner), _running(F.col(b), inner), lambda r, c: F.struct(r.alias("r"), c.alias("c")))


def stability_index(a: str, b: str, edges: str) -> Column:
    """PSI over the reference's decile bins, open at both ends, one added to every bin."""
    bins = F.size(edges) - 1
    inner = F.slice(edges, F.lit(2), F.greatest(bins - 1, F.lit(0)))
    first = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("psi"))

    def step(s: Column, e: Column) -> Column:
        p = (e["r"] - s["r"] + 1) / (F.size(a) + bins)
        q = (e["c"] - s["c"] + 1) / (F.size(b) + bins)
        return F.struct(e["r"].alias("r"), e["c"].alias("c"), (s["psi"] + (q - p) * F.ln(q / p)).alias("psi"))

    cells = F.slice(_bins(a, b, inner), F.lit(2), F.greatest(bins, F.lit(0)))
    return F.when(F.size(edges) < 2, F.lit(0.0)).otherwise(F.aggregate(cells, first, step)["psi"])


EPSILON = 1e-9


def jensen_shannon(a: str, b: str, bins: int = 10) -> Column:
    """Base-2 Jensen–Shannon distance over equal bins of the joint range. Inputs sorted."""
    low = F.least(F.element_at(a, 1), F.element_at(b, 1))
    high = F.greatest(F.element_at(a, -1), F.element_at(b, -1))
    width = (high - low) / bins
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: low + i * width)
    first = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("js"))

    def step(s: Column, e: Column) -> Column:
        p = (e["r"] - s["r"] + EPSILON) / (F.size(a) + EPSILON * bins)
        q = (e["c"] - s["c"] + EPSILON) / (F.size(b) + EPSILON * bins)
        m = (p + q) / 2
        part = p * F.ln(p / m) + q * F.ln(q / m)
        return F.struct(e["r"].alias("r"), e["c"].alias("c"), (s["js"] + part).alias("js"))

    cells = F.slice(_bins(a, b, inner), F.lit(2), F.lit(bins))
    total = F.aggregate(cells, first, step)["js"]
    return F.when(low == high, F.lit(0.0)).otherwise(F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * math.log(2))))


def two_sample(df: DataFrame, algorithm: Column, reference: Column, current: Column, out: str = "statistic") -> DataFrame:
    """Add the statistic each row's algorithm asks for; only that branch is evaluated."""
    df = pinned(df, _alg=algorithm, _a=F.sort_array(reference), _b=F.sort_array(current))
    df = pinned(df, _edges=F.when(F.col("_alg") == PSI, psi_edges(F.col("_a"))))
    value = (
        F.when(F.col("_alg") == PSI, stability_index("_a", "_b", "_edges"))
        .when(F.col("_alg") == KS, kolmogorov_smirnov("_a", "_b"))
        .when(F.col("_alg") == WASSERSTEIN, wasserstein("_a", "_b"))
    )
    for name, build in registry.STATISTICS.items():
        value = value.when(F.col("_alg") == name, build("_a", "_b"))
    value = value.otherwise(jensen_shannon("_a", "_b"))
    return df.withColumn(out, value).drop("_alg", "_a", "_b", "_edges")


def draw(iteration: Column, position: Column, side: int, size: Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random index in 0..size-1 from whole-number mixing only."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    h = (iteration.cast("long") * 7919 + position.cast("long") * 104729 + side * 1299709 + seed * 15485863).bitwiseAND(mask)
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * 739982445).bitwiseAND(mask)
    h = (h.bitwiseXOR(F.shiftright(h, 12)) * 695872825).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    return F.pmod(h, size.cast("long")).cast("int")


# -- normality ---------------------------------------------------------------


def normal_cdf(z: Column) -> Column:
    """Φ(z) by the Abramowitz–Stegun 26.2.17 polynomial (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def shapiro_weights(n: int) -> list[float]:
    """Royston (1995) coefficients for a sorted sample of n >= 12."""
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total = sum(x * x for x in m)
    u = 1 / math.sqrt(n)
    last = m[-1] / math.sqrt(total) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - u * 2.706056))))
    second = m[-2] / math.sqrt(total) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - u * 3.582633))))
    phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    inner = [x / math.sqrt(phi) for x in m[2:-2]]
    return [-last, -second, *inner, second, last]


# Coefficients of the normal quantile, algorithm AS 241, lowest power first; for the middle and for the tails.
_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)


def inverse_normal(p: Column) -> Column:
    """Normal quantile for probabilities from 1e-10 to 1 - 1e-10."""

    def ratio(x: Column, of: tuple) -> Column:
        powers = lambda c: functools.reduce(lambda total, k: total * x + F.lit(k), reversed(c[:-1]), F.lit(c[-1]))
        return powers(of[0]) / powers(of[1])

    q = p - 0.5
    tail = ratio(F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6, _TAIL)
    return F.when(F.abs(q) <= 0.425, q * ratio(F.lit(0.180625) - q * q, _MIDDLE)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def with_shapiro_weights(lengths: DataFrame, size: str, name: str) -> DataFrame:
    """Add the weights of `shapiro_weights` for each row's sample size, as array expressions."""
    n = F.col(size)
    scores = F.transform(F.sequence(F.lit(1), n), lambda i: inverse_normal((i - 0.375) / (n + 0.25)))
    out = pinned(lengths, _scores=scores)
    out = pinned(out, _total=F.aggregate("_scores", F.lit(0.0), lambda s, m: s + m * m), _u=1 / F.sqrt(n.cast("double")))
    u, top, next_ = F.col("_u"), F.element_at("_scores", -1), F.element_at("_scores", -2)
    last = top / F.sqrt("_total") + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - u * 2.706056))))
    second = next_ / F.sqrt("_total") + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - u * 3.582633))))
    out = pinned(out, _last=last, _second=second)
    phi = (F.col("_total") - 2 * top * top - 2 * next_ * next_) / (1 - 2 * F.col("_last") * F.col("_last") - 2 * F.col("_second") * F.col("_second"))
    out = pinned(out, _root=F.sqrt(phi))
    weight = lambda m, i: (
        F.when(i == 0, -F.col("_last")).when(i == 1, -F.col("_second")).when(i == n - 1, F.col("_last")).when(i == n - 2, F.col("_second")).otherwise(m / F.col("_root"))
    )
    return out.withColumn(name, F.transform("_scores", weight)).drop("_scores", "_total", "_u", "_last", "_second", "_root")


def shapiro_z(w: Column, n: Column) -> Column:
    """Normal score of the Shapiro–Wilk W for n >= 12; its p-value is 1 - Φ(z)."""
    x = F.ln(n)
    mean = -1.5861 + x * (-0.31082 + x * (-0.083751 + x * 0.0038915))
    spread = F.exp(-0.4803 + x * (-0.082676 + x * 0.0030302))
    return (F.ln(F.greatest(1 - w, F.lit(1e-19))) - mean) / spread


def with_dagostino_p(df: DataFrame, skewness: Column, kurtosis: Column, n: Column, out: str) -> DataFrame:
    """Add the p-value of the D'Agostino–Pearson K² from population skewness and (non-excess) kurtosis.

    Built in pinned steps: written as one expression, its repeated parts would
    multiply into code too large to compile.
    """
    c = F.col
    n = F.greatest(n.cast("double"), F.lit(20.0))  # the test is not defined for tiny samples
    df = pinned(df, _n=n, _skew=skewness, _kurt=kurtosis)
    n = c("_n")
    df = pinned(
        df,
        _y=c("_skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
        _w2=-1 + F.sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)),
        _x=(c("_kurt") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))),
        _root=6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
    )
    df = pinned(
        df,
        _u=c("_y") / F.sqrt(2 / (c("_w2") - 1)),
        _a=6 + 8 / c("_root") * (2 / c("_root") + F.sqrt(1 + 4 / (c("_root") * c("_root")))),
    )
    df = pinned(
        df,
        _z1=F.ln(c("_u") + F.sqrt(c("_u") * c("_u") + 1)) / F.sqrt(0.5 * F.ln("_w2")),
        _base=(1 - 2 / c("_a")) / (1 + c("_x") * F.sqrt(2 / (c("_a") - 4))),
    )
    cube = F.signum("_base") * F.pow(F.abs("_base"), F.lit(1 / 3))
    df = pinned(df, _z2=(1 - 2 / (9 * c("_a")) - cube) / F.sqrt(2 / (9 * c("_a"))))
    return df.withColumn(out, F.exp(-(c("_z1") * c("_z1") + c("_z2") * c("_z2")) / 2)).drop(
        "_n", "_skew", "_kurt", "_y", "_w2", "_x", "_root", "_u", "_a", "_z1", "_base", "_z2"
    )
