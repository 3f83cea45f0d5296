"""Drift statistics against plain numpy formulas, degenerate samples included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keycast.config import Drift
from keycast.functions import samples as S

rng = np.random.default_rng(7)
CASES = {
    "plain": (rng.normal(50, 5, 37), rng.normal(55, 8, 12)),
    "ties": (np.array([1, 1, 2, 2, 3, 3, 3, 4.0]), np.array([2, 2, 3, 9.0])),
    "constant": (np.full(10, 5.0), np.full(4, 5.0)),
    "constant_vs_other": (np.full(10, 5.0), np.array([5.0, 7.0])),
    "two_values": (np.array([1.0, 2.0] * 6), np.array([1.0, 3.0])),
    "one_point": (rng.normal(0, 1, 15), np.array([0.2])),
    "huge": (rng.normal(1e12, 1e10, 24), rng.normal(1.1e12, 1e10, 12)),
    "tiny": (rng.normal(1e-12, 1e-13, 24), rng.normal(1e-12, 1e-13, 12)),
    "crossing": (rng.normal(0, 1, 30), -rng.normal(0, 1, 12)),
}


def np_ks(a, b):
    x = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)))


def np_wasserstein(a, b):
    x = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), x[:-1], "right") / len(a) - np.searchsorted(np.sort(b), x[:-1], "right") / len(b))
    raw = np.sum(gap * np.diff(x))
    return raw / np.std(a) if np.std(a) > 0 else raw


def np_psi(a, b):
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    if edges.size < 3:
        edges = np.unique([a.min(), np.median(a), a.max()])
    if edges.size < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    r, c = np.histogram(a, edges)[0] + 1.0, np.histogram(b, edges)[0] + 1.0
    r, c = r / r.sum(), c / c.sum()
    return float(np.sum((c - r) * np.log(c / r)))


def np_js(a, b):
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    if lo == hi:
        return 0.0
    edges = np.linspace(lo, hi, 11)
    p, q = np.histogram(a, edges)[0] + 1e-9, np.histogram(b, edges)[0] + 1e-9
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return math.sqrt(max(0.0, (np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2 / math.log(2)))


@pytest.mark.parametrize("algorithm,formula", [(S.KS, np_ks), (S.WASSERSTEIN, np_wasserstein), (S.PSI, np_psi), (S.JS, np_js)])
def test_statistic_equals_numpy(spark, algorithm, formula):
    rows = [(k, [float(x) for x in a], [float(x) for x in b]) for k, (a, b) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, a array<double>, b array<double>")
    got = {r.name: r.statistic for r in S.two_sample(df, F.lit(algorithm), F.col("a"), F.col("b")).collect()}
    for name, (a, b) in CASES.items():
        assert got[name] == pytest.approx(formula(a, b), rel=1e-9, abs=1e-9), name


def test_psi_never_scores_out_of_range_below_in_range(spark):
    base = [50.0, 55.0, 60.0, 65.0, 70.0]
    rows = [(n, base, v) for n, v in {"in": [60.0] * 4, "edge": [72.0] * 4, "far": [300.0] * 4, "low": [1.0] * 4}.items()]
    df = spark.createDataFrame(rows, "name string, a array<double>, b array<double>")
    got = {r.name: r.statistic for r in S.two_sample(df, F.lit(S.PSI), F.col("a"), F.col("b")).collect()}
    for name in ("far", "low", "edge"):
        assert got[name] >= got["in"] - 1e-12, name


def test_shapiro_weights_are_a_unit_antisymmetric_vector():
    for n in (12, 20, 36, 104, 180):
        w = S.shapiro_weights(n)
        assert sum(x * x for x in w) == pytest.approx(1.0, abs=1e-9)
        assert w == pytest.approx([-x for x in reversed(w)], abs=1e-12)


def test_normality_separates_normal_from_skewed(spark):
    from keycast.operators import drift

    normal = [float(x) for x in np.random.default_rng(1).normal(0, 1, 60)]
    skewed = [float(x) for x in np.random.default_rng(1).exponential(1, 60)]
    long_normal = [float(x) for x in np.random.default_rng(2).normal(0, 1, 400)]
    long_skewed = [float(x) for x in np.random.default_rng(2).exponential(1, 400)]
    df = spark.createDataFrame([("n", normal), ("s", skewed), ("ln", long_normal), ("ls", long_skewed)], "group_id string, history array<double>")
    for limit, long_test in ((2000, "Shapiro-Wilk"), (180, "D'Agostino-Pearson")):
        got = {r.group_id: (r.normality_test, r.p_value) for r in drift.normality(df, Drift(shapiro_max_rows=limit)).collect()}
        assert got["n"][1] > 0.05 > got["s"][1] and got["ln"][1] > 0.05 > got["ls"][1]
        assert got["n"][0] == "Shapiro-Wilk" and got["ln"][0] == long_test


def test_draws_are_in_range_and_spread_out(spark):
    draws = spark.range(200).select(F.explode(F.sequence(F.lit(1), F.lit(18))).alias("i"), "id").select(S.draw(F.col("id"), F.col("i"), 1, F.lit(18)).alias("d"))
    counts = [r["count"] for r in draws.groupBy("d").count().collect()]
    assert len(counts) == 18 and min(counts) > 140 and max(counts) < 260


def test_trend_has_a_wider_null_than_flat_and_repeats(spark):
    from keycast.operators import drift

    rows = [("trend", [10 + 0.5 * i for i in range(60)]), ("flat", [10 + 0.5 * (i % 3) for i in range(60)]), ("mod", [float(i % 10) for i in range(40)])]
    df = spark.createDataFrame(rows, "group_id string, history array<double>")
    chosen = drift.choose_algorithm(df)
    read = lambda: {r.group_id: (r.threshold, r.method, r.null_size) for r in drift.thresholds(chosen, drift.null_statistics(chosen)).collect()}
    first, second = read(), read()
    assert first == second
    assert first["trend"][0] > first["flat"][0]
    assert first["mod"][1:] == ("bootstrap", 200) and first["trend"][1] == "kernel_density"


def test_shapiro_weights_of_any_length_equal_the_closed_form(spark):
    """Quantiles by expression against the standard library, up to 2,000 values."""
    from statistics import NormalDist

    ps = [1e-6, 0.0003, 0.01, 0.074, 0.075, 0.2, 0.5, 0.8, 0.926, 0.99, 0.9997]
    got = [r.z for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(S.inverse_normal(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)
    made = S.with_shapiro_weights(spark.createDataFrame([(n,) for n in (12, 36, 200, 1999)], "n int"), "n", "w").collect()
    for r in made:
        assert r.w == pytest.approx(S.shapiro_weights(r.n), rel=1e-11, abs=1e-14)


def test_long_samples_are_judged_by_shapiro_wilk(spark):
    import random

    from keycast.operators import drift

    rnd = random.Random(4)
    rows = [("normal", [rnd.gauss(5, 2) for _ in range(900)]), ("skewed", [rnd.expovariate(1) for _ in range(900)]), ("long", [rnd.gauss(0, 1) for _ in range(2100)])]
    found = {r.group_id: r for r in drift.normality(spark.createDataFrame(rows, "group_id string, history array<double>")).collect()}
    assert found["normal"].normality_test == found["skewed"].normality_test == "Shapiro-Wilk" and found["long"].normality_test == "D'Agostino-Pearson"
    assert found["normal"].p_value > 0.05 and found["skewed"].p_value < 1e-6 and found["long"].p_value > 0.01
