"""Cleaning, skewed keys, grouping, features, folds and models on small frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keycast.config import Backtest, Cleaning, ConfigurationError, DataError, Roles, check_horizon, resolve_features, resolve_models
from keycast.functions import skew
from keycast.operators import clean, coercion, features, folds, profile
from keycast.operators import series as series_ops
from keycast.operators.models import autoregressive, naive, trend
from keycast.sources import tables

R = Roles("ts", "y", ("k",))


def hot_rows(n=600):
    """A third of all rows sit in one key and one timestamp; one key is null."""
    random.seed(3)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        key = "hot" if hot or i % 5 == 0 else (None if i % 17 == 0 else f"k{i % 7}")
        ts = dt.datetime(2024, 1, 1) if hot else dt.datetime(2024, 1, 1) + dt.timedelta(hours=random.randrange(900))
        rows.append((i, key, ts, None if random.random() < 0.3 else float(random.randrange(1000))))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, y double"), pd.DataFrame(rows, columns=["id", "k", "ts", "y"])


@pytest.mark.parametrize("strategy", ["forward_fill", "backward_fill", "interpolate", "mean", "median", "zero", "drop"])
def test_fills_match_pandas_on_a_hot_key(spark, hot, strategy):
    df, pdf = hot
    got = {r.id: r.y for r in clean.fill_missing(df, R, strategy, ["ts", "id"]).collect()}
    pdf = pdf.sort_values(["ts", "id"]).assign(k=lambda d: d.k.fillna("<null>"))
    by = pdf.groupby("k")["y"]
    want = {
        "forward_fill": lambda: by.ffill(), "backward_fill": lambda: by.bfill(), "interpolate": lambda: by.transform(lambda s: s.interpolate()),
        "mean": lambda: by.transform(lambda s: s.fillna(s.mean())), "median": lambda: by.transform(lambda s: s.fillna(s.median())),
        "zero": lambda: pdf.y.fillna(0), "drop": lambda: pdf.y,
    }[strategy]()
    expected = {i: v for i, v in zip(pdf.id, want) if not np.isnan(v)}
    assert got.keys() == expected.keys()
    for i, v in expected.items():
        assert got[i] == pytest.approx(v, abs=1e-9)


def test_exact_quantiles_and_positions_on_a_hot_key(spark, hot):
    df, pdf = hot
    got = {r.k: (r.q_0, r.q_1) for r in skew.exact_quantiles(df.where("k is not null"), ["k"], "y", [0.25, 0.9]).collect()}
    for k, s in pdf.dropna(subset=["k"]).groupby("k")["y"]:
        assert got[k] == pytest.approx((np.nanquantile(s, 0.25), np.nanquantile(s, 0.9)))
    positions = {r.id: r.position for r in skew.global_positions(df.select("ts", "id"), ["ts", "id"]).collect()}
    assert [positions[i] for i in pdf.sort_values(["ts", "id"]).id] == list(range(len(pdf)))


def test_running_total_on_a_hot_key(spark, hot):
    df, pdf = hot
    rows = df.where("k is not null").withColumn("v", F.coalesce("y", F.lit(0.0)))
    got = {r.id: r.before for r in skew.running_total(rows, ["k"], ["ts", "id"], "v", "before").collect()}
    p = pdf.dropna(subset=["k"]).fillna({"y": 0.0}).sort_values(["ts", "id"])
    want = dict(zip(p.id, p.groupby("k")["y"].cumsum() - p.y))
    assert got == pytest.approx(want)


def test_pages_follow_the_order_and_do_not_overlap(spark, hot):
    df, _ = hot
    whole = [r.id for r in df.orderBy("ts", "id").collect()]
    assert [r.id for r in tables.page(df, ["ts", "id"], 5, 50).collect()] == whole[200:250]
    ties = [r.id for n in (1, 2, 3) for r in tables.page(df, ["k"], n, 300).collect()]
    assert len(ties) == len(set(ties))


def test_running_total_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0), (3, "a", 5.0)], "id long, k string, v double")
    got = {r.id: r.before for r in skew.running_total(rows, ["k"], ["id"], "v", "before").collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}


def test_keys_that_hold_the_separator_stay_apart(spark):
    rows = [("a | b", "c", f"2024-{m:02d}-01", 1.0) for m in range(1, 13)] + [("a", "b | c", f"2024-{m:02d}-01", 2.0) for m in range(1, 13)]
    table = spark.createDataFrame(rows, "x string, y string, d string, v double")
    out = series_ops.build_series(table, Roles("d", "v", ("x", "y"))).collect()
    assert len({r.group_id for r in out}) == 2
    assert all(len({r.y for r in out if r.group_id == g}) == 1 for g in {r.group_id for r in out})


def test_number_keys_are_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "date'2024-01-01' as d", "double(id) as v").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = tables.full_series(table, "d", "v", {"k": "7.0"})
    assert [r.y for r in found.collect()] == [7.0]
    assert "EqualTo(k,7)" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step,label", [(1, "Daily"), (7, "Weekly"), (30, "Monthly"), (91, "Quarterly"), (365, "Yearly"), (500, "Irregular")])
def test_frequency_bands(spark, step, label):
    days = [(dt.date(2010, 1, 1) + dt.timedelta(days=step * i),) for i in range(8)]
    assert profile.frequency(spark.createDataFrame(days, "d date"), "d").first().frequency == label


def test_frequency_holes_between_bands_are_irregular(spark):
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=d),) for d in (0, 1, 3)]  # median gap 1.5
    row = profile.frequency(spark.createDataFrame(days, "d date"), "d").first()
    assert (row.median_gap_days, row.frequency) == (1.5, "Irregular")
    assert profile.frequency(spark.createDataFrame(days[:1], "d date"), "d").first().frequency == "Irregular"


def test_dates_and_targets_are_refused_or_converted(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d}", str(d), d, True) for d in range(1, 29)], "d string, y string, n int, b boolean")
    typed = coercion.coerce(df, "d", "y", Cleaning())
    assert typed.schema["d"].dataType.simpleString() == "timestamp_ntz" and typed.agg(F.sum("y")).first()[0] == 406.0
    for date, target in (("n", "y"), ("b", "y"), ("d", "d")):
        with pytest.raises(DataError):
            coercion.coerce(df, date, target, Cleaning())
    bad = df.withColumn("y", F.when(F.col("n") < 4, "x").otherwise(F.col("y")))
    with pytest.raises(DataError):
        coercion.coerce(bad, "d", "y", Cleaning())


def test_roles_horizon_models_and_features_are_checked():
    with pytest.raises(ConfigurationError):
        Roles("a", "a").check()
    with pytest.raises(ConfigurationError, match="x, y"):
        Roles("x", "y").check(["a"])
    with pytest.raises(ConfigurationError):
        check_horizon(5)
    with pytest.raises(ConfigurationError):
        resolve_models(["seasonal_naive"])
    assert [m.name for m in resolve_models(["random_forest", "autoregressive"])] == ["autoregressive", "random_forest"]
    assert resolve_features([]) == {"lags": [], "rolling_windows": [], "calendar_features": [], "rejected": []}
    assert resolve_features(["lag_2", "nope"])["rejected"] == ["nope"] and resolve_features()["lags"] == [1, 2, 3, 12]


def ramp(spark, n=30, keys=("a",)):
    rows = [(k, i, n, dt.date(2021 + i // 12, i % 12 + 1, 1), 100.0 + 2 * i) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "group_id string, t int, n int, ds date, y double")


def test_lags_never_cross_keys_and_spans_shrink(spark):
    both = ramp(spark, 14, ("a", "b"))
    rows = features.derived(both, ["group_id"], ["t"], "y", "ds").orderBy("group_id", "t").collect()
    for r in rows:
        assert (r.lag_1 is None) == (r.t == 0) and (r.rolling_mean_3 is None) == (r.t < 3)
    matrix = features.design_matrix(both, ["group_id"])
    first = matrix.where("group_id = 'a'").orderBy("t").first()
    assert first.t == 6 and first.lag_12 is None and first.label == 2.0


def test_fold_bounds_follow_the_settings(spark):
    facts = spark.createDataFrame([("a", 14), ("b", 15), ("c", 30)], "group_id string, n int")
    read = lambda o: sorted((r.group_id, r.fold, r.train_start, r.train_end) for r in folds.fold_table(facts, o).collect())
    assert read(Backtest()) == [("b", 0, 0, 12)] + [("c", k, 3 * k, 12 + 3 * k) for k in range(5)]
    assert read(Backtest(strategy="expanding"))[-1] == ("c", 4, 0, 24)
    assert read(Backtest(newest_first=True))[-1] == ("c", 4, 15, 27)


def test_models_on_a_ramp(spark):
    frame = folds.frame(ramp(spark), horizon=12)
    ahead = lambda m: [r.value for r in m.predict(frame).where("fold = -1").orderBy("step").collect()]
    assert ahead(trend) == pytest.approx([160 + 2 * i for i in range(12)])
    assert ahead(naive) == pytest.approx([100 + 2 * (18 + i) for i in range(12)])
    assert len(ahead(autoregressive)) == 12


def test_autoregression_matches_least_squares(spark):
    r = np.random.default_rng(5)
    y = [0.0, 0.0]
    for _ in range(120):
        y.append(0.5 * y[-1] + 0.3 * y[-2] + r.normal())
    rows = [("a", i, len(y), dt.date(2000, 1, 1) + dt.timedelta(days=31 * i), float(v)) for i, v in enumerate(y)]
    frame = folds.frame(spark.createDataFrame(rows, "group_id string, t int, n int, ds date, y double"))
    fit = autoregressive.fits(frame).where("fold = -1").first()
    z = np.array(y) - np.mean(y)
    if (fit.p, fit.d) == (2, 0):
        design = np.column_stack([np.ones(len(z) - 3), z[2:-1], z[1:-2]])
        a, b1, b2 = np.linalg.lstsq(design, z[3:], rcond=None)[0]
        assert (fit.a, fit.c1, fit.c2) == pytest.approx((a, b1, b2), rel=1e-8)
    path = [r.value for r in autoregressive.predict(frame).where("fold = -1").orderBy("step").collect()]
    state, want = list(z), []
    for _ in range(12):
        state.append(fit.a + fit.c1 * state[-1] + fit.c2 * state[-2] + fit.c3 * state[-3])
        want.append(state[-1] + np.mean(y))
    assert path == pytest.approx(want, rel=1e-9)


def test_loader_names_what_is_wrong(spark, tmp_path):
    with pytest.raises(tables.DatasetError, match="could not be found"):
        tables.load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(tables.DatasetError, match="Unsupported"):
        tables.load_table(spark, str(tmp_path / "x.txt"))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(tables.DatasetError, match="empty"):
        tables.load_table(spark, str(tmp_path / "empty.csv"))


def test_forecast_export_skips_groups_without_forecast(spark):
    rows = [("1 | 1", "m", "2024-01-01", 1.0), ("1 | 1", "m", "2024-02-01", 2.0), ("1 | 2", "m", "2024-01-01", 3.0), ("1 | 2", "other", "2024-01-01", 9.0)]
    f = spark.createDataFrame(rows, "group_id string, model_name string, ds string, value double").withColumn("lower", F.lit(None).cast("double")).withColumn("upper", F.lit(None).cast("double"))
    winners = spark.createDataFrame([("1 | 1", "m"), ("1 | 2", "m"), ("1 | 3", "m")], "group_id string, model_name string")
    assert tables.forecast_rows(f, winners).count() == 3


def test_duplicate_month_rows_stop_a_run(spark):
    rows = [(dt.date(2020, 1, 1), float(i), "a") for i in range(20)]
    with pytest.raises(DataError, match="more than one row"):
        clean.verify(spark.createDataFrame(rows, "ts date, y double, k string"), R)


def test_regressors_are_fitted_jointly_with_trend_and_months(spark):
    """Equal to least squares on the full design, on whole and on broken years."""
    rng = np.random.default_rng(3)
    n = 41
    promo, price = rng.integers(0, 2, n).astype(float), rng.random(n) * 1000
    gone = np.arange(n) == 17
    y = 50 + 2 * np.arange(n) + 30 * promo - 0.01 * price + 5 * (np.arange(n) % 12 == 3) + rng.normal(0, 0.1, n)
    rows = [("g", t, n, dt.date(2020 + t // 12, t % 12 + 1, 1), float(y[t]), float(promo[t]), None if gone[t] else float(price[t]), 7.0) for t in range(n)]
    series = spark.createDataFrame(rows, "group_id string, t int, n int, ds date, y double, promo double, price double, same double")
    frame = folds.frame(series, Backtest(), 3, ["promo", "price", "same"])
    filled = np.where(gone, price[~gone].mean(), price)
    design = lambda t, a, b: np.stack([np.ones(len(t)), t, *[(t % 12 == m).astype(float) for m in range(12)], a, b], axis=1)
    x = design(np.arange(n), promo, filled)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    fitted = trend.fitted(frame, ["promo", "price", "same"]).where("fold = -1").collect()
    got = {r.t: r.fit for r in fitted}
    assert [got[t] for t in range(n)] == pytest.approx((x @ beta).tolist(), rel=1e-7)
    ahead = design(np.arange(n, n + 3), np.full(3, promo[-1]), np.full(3, price[-1])) @ beta
    assert [got[t] for t in range(n, n + 3)] == pytest.approx(ahead.tolist(), rel=1e-7)
    assert fitted[0].sigma == pytest.approx(np.std(y - x @ beta, ddof=1), rel=1e-4)


def test_a_fold_of_one_year_keeps_to_its_line(spark):
    """With a row per month the months take what the line leaves, as without regressors."""
    rows = [("g", t, 15, dt.date(2020 + t // 12, t % 12 + 1, 1), 100.0 + 3 * t + (t * 7 % 5), float(t % 2)) for t in range(15)]
    series = spark.createDataFrame(rows, "group_id string, t int, n int, ds date, y double, promo double")
    frame = folds.frame(series, Backtest(), 3, ["promo"]).where("fold = 0")
    plain = {r.step: r.value for r in trend.predict(frame).collect()}
    more = {r.step: r.value for r in trend.predict(frame.withColumn("promo", F.lit(1.0)), ["promo"]).collect()}
    assert len(plain) == 3 and more == pytest.approx(plain, rel=1e-4)
