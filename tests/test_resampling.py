"""Nulls and thresholds worked out in batches against the same formulas as expressions and in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keycast.config import Drift
from keycast.functions import resampling
from keycast.functions import samples as S
from keycast.operators import drift

rng = np.random.default_rng(11)
HISTORIES = {
    "plain": rng.normal(50, 5, 36), "odd": rng.normal(50, 5, 25), "ties": np.array([1.0, 2.0, 2.0, 3.0] * 9), "constant": np.full(30, 5.0),
    "two_values": np.array([1.0] * 20 + [2.0] * 5), "short": rng.normal(1, 1, 7), "pair": np.array([1.0, 4.0]), "huge": rng.normal(1e12, 1e10, 30),
}


def chosen(spark, algorithm):
    rows = [(k, [float(x) for x in v], len(v), algorithm) for k, v in HISTORIES.items()]
    return spark.createDataFrame(rows, "group_id string, history array<double>, sample_size int, algorithm string")


@pytest.mark.parametrize("algorithm", S.ALGORITHMS)
@pytest.mark.parametrize("method", ["bootstrap", "percentile"])
def test_batches_give_what_expressions_give(spark, algorithm, method):
    options = Drift(method=method, resamples=40)
    keys = chosen(spark, algorithm)
    batched = {(r.group_id, r.iteration): r.statistic for r in drift.null_statistics(keys, options).collect()}
    plain = {(r.group_id, r.iteration): r.statistic for r in drift._expressed(drift._ready(keys, options), options).collect()}
    assert batched.keys() == plain.keys()
    for at, value in plain.items():
        assert batched[at] == pytest.approx(value, rel=1e-9, abs=1e-12), at


@pytest.mark.parametrize("method", ["bootstrap", "kernel_density"])
def test_thresholds_by_key_equal_those_by_row(spark, method):
    options = Drift(method=method, percentile=0.8)
    keys = chosen(spark, S.KS)
    by_key = {r.group_id: (r.threshold, r.null_size) for r in drift.thresholds(keys, drift.key_nulls(keys, options), options).collect()}
    by_row = {r.group_id: (r.threshold, r.null_size) for r in drift.thresholds(keys, drift.null_statistics(keys, options), options).collect()}
    assert by_key == by_row
    if method == "bootstrap":
        read = drift.null_statistics(keys, options).groupBy("group_id").agg(F.percentile("statistic", F.lit(0.8)).alias("q")).collect()
        assert {k: v[0] for k, v in by_key.items()} == {r.group_id: r.q for r in read}
    assert by_key["constant"][0] == 0.0


def test_a_null_is_no_expression_over_resamples(spark):
    """200 resamples of every key as nested array expressions took 70 ms of CPU time a key."""
    plan = drift.key_nulls(chosen(spark, S.KS))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


def test_work_is_cut_into_bounded_arrays(monkeypatch):
    rows = rng.normal(0, 1, (50, 36))
    whole = resampling.resample_statistics(rows, S.WASSERSTEIN, 20, 42)
    monkeypatch.setattr(resampling, "AT_ONCE", 3 * 20 * 36)
    assert np.array_equal(whole, resampling.resample_statistics(rows, S.WASSERSTEIN, 20, 42))
