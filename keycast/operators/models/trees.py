"""Tree candidates: pooled models over all keys, cut by calendar date, forecast recursively.

Each series is scaled by its own spread, so one model serves every key; Spark
trains it on all executors. A backtest fold of a key is predicted by the model
of a calendar border at or before the end of the fold's training rows, and that
model has seen no row of any key after its border. So no key's later months
reach another key's test, however the keys' calendars are shifted. The forward
forecast is made by one more model, of all rows.

Models of all borders are fitted side by side, and all folds move through one
recursion: the number of jobs does not grow with the folds.
"""

from __future__ import annotations

import datetime as dt
import json
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keycast.config import LAGS, ROLLING_WINDOWS, Importance, Search
from keycast.functions.samples import draw
from keycast.functions.skew import spread, stable
from keycast.operators import features, importance
from keycast.operators.folds import FORWARD
from keycast.operators.models.naive import newest, tests

SCALED = [f"lag_{n}" for n in LAGS] + [f"rolling_mean_{n}" for n in ROLLING_WINDOWS]
MEMORY = max(LAGS)  # newest values a step needs
ABSENT = -1e6  # a span the series is too short for: a z-score of n values is under sqrt(n), so no value comes near
AT_ONCE = 4  # fits that Spark works on side by side
DEFAULTS = {
    "boosted_trees": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1},
    "random_forest": {"numTrees": 20, "maxDepth": 6},
}
SEARCH = {  # parameter → values tried
    "boosted_trees": {"maxIter": [20, 40], "maxDepth": [3, 4, 5], "stepSize": [0.05, 0.1, 0.2]},
    "random_forest": {"numTrees": [20, 40], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 5]},
}
KEY = ["group_id", "fold"]


def estimator(name: str, params: dict | None = None, seed: int = 42):
    made = {"boosted_trees": GBTRegressor, "random_forest": RandomForestRegressor}[name]
    return made(featuresCol="features", labelCol="scaled_label", predictionCol="change", seed=seed, **{**DEFAULTS[name], **(params or {})})


def feature_columns(regressors: list[str] = (), spec: dict | None = None) -> list[str]:
    return [*features.feature_names(spec), *regressors]


def together(work: list[Callable]) -> list:
    """Results of several Spark actions that run side by side, in order."""
    if not work:
        return []
    inherits = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(AT_ONCE, len(work))) as pool:
        return list(pool.map(lambda run: run(), [inherits(w) for w in work]))


# -- calendar borders -------------------------------------------------------------


def borders(frame: DataFrame, most: int = 8) -> list[dt.date]:
    """Ends of training by calendar date, the earliest and `most` in all, evenly chosen of those that occur.

    One row per date comes here: the calendar bounds them, not the keys.
    """
    ends = frame.where((F.col("part") == "train") & (F.col("fold") >= 0)).groupBy(*KEY).agg(F.max("ds").cast("date").alias("end"))
    days = sorted(r.end for r in ends.select("end").distinct().collect())
    if len(days) <= most:
        return days
    return sorted({days[i * (len(days) - 1) // (most - 1)] for i in range(most)})


def with_border(frame: DataFrame, days: list[dt.date]) -> DataFrame:
    """Add `border`, the place of the latest border at or before the end of a fold's training rows (their number for the forward fold), and drop folds without one."""
    end = F.max(F.when(F.col("part") == "train", F.col("ds").cast("date"))).over(Window.partitionBy(*KEY))
    reached = sum((F.when(F.col("_end") >= F.lit(d), 1).otherwise(0) for d in days), F.lit(0)) - 1
    out = frame.withColumn("_end", end).withColumn("border", F.when(F.col("fold") == FORWARD, F.lit(len(days))).otherwise(reached).cast("int"))
    return out.where("border >= 0").drop("_end")


# -- rows to learn from -------------------------------------------------------------


def _spread_of(value: str, window) -> Column:
    width = F.stddev_pop(value).over(window)
    return F.when(width > 0, width).otherwise(F.lit(1.0))


def scaled_matrix(rows: DataFrame, keys: list[str], regressors: list[str] = (), spec: dict | None = None) -> DataFrame:
    """Complete training rows of every key with features, regressors and label in units of the key's own spread.

    A missing regressor counts as the key's mean, here as in forecasts.
    """
    whole = Window.partitionBy(*keys)
    based = rows.withColumn("level", F.avg("y").over(whole)).withColumn("width", _spread_of("y", whole))
    for c in regressors:
        based = based.withColumn(c, F.coalesce((F.col(c).cast("double") - F.avg(c).over(whole)) / _spread_of(c, whole), F.lit(0.0)))
    matrix = features.design_matrix(based, keys, spec)
    for c in SCALED:
        if c in matrix.columns:
            matrix = matrix.withColumn(c, F.coalesce((F.col(c) - F.col("level")) / F.col("width"), F.lit(ABSENT)))
    matrix = matrix.where(F.col("label").isNotNull()).withColumn("scaled_label", F.col("label") / F.col("width"))
    for c in ("month", "quarter"):
        if c in matrix.columns:
            matrix = matrix.withColumn(c, F.col(c).cast("double"))
    return matrix


def assembled(rows: DataFrame, regressors: list[str] = (), spec: dict | None = None) -> DataFrame:
    return VectorAssembler(inputCols=feature_columns(regressors, spec), outputCol="features").transform(rows)


def training_rows(frame: DataFrame, regressors: list[str] = (), days: list[dt.date] | None = None, spec: dict | None = None) -> DataFrame:
    """Training rows per (group, fold) with the border of the model they may enter.

    Rows after the border, though before the fold's own end, stay out, and so they
    do not shape the scale of the others. Of folds of a key that share a
    border only the latest gives rows.
    """
    days = borders(frame) if days is None else days
    placed = with_border(frame, days).where("part = 'train'")
    limit = F.element_at(F.array(*[F.lit(d) for d in days], F.lit(dt.date(9999, 1, 1))), F.col("border") + 1)
    latest = F.max("fold").over(Window.partitionBy("group_id", "border"))
    seen = placed.where(F.col("ds").cast("date") <= limit).withColumn("_latest", latest).where("fold = _latest")
    return scaled_matrix(seen.select("group_id", "fold", "border", "n", "t", "ds", "y", *regressors), KEY, regressors, spec)


def fit_borders(matrix: DataFrame, name: str, numbers: list[int], params: dict | None = None, regressors: list[str] = (), spec: dict | None = None) -> dict:
    """One pooled model per border number: a bounded handful of distributed fits, side by side."""
    fit = lambda k: lambda: estimator(name, params).fit(assembled(matrix.where(F.col("border") == k), regressors, spec))
    return dict(zip(numbers, together([fit(k) for k in numbers]), strict=True))


# -- recursion -----------------------------------------------------------------------


def states(frame: DataFrame, regressors: list[str] = ()) -> DataFrame:
    """Per (group, fold): the newest values (oldest first), scaling facts and the steps to forecast."""
    trained = lambda c: F.when(F.col("part") == "train", F.col(c).cast("double"))
    wide = lambda c: F.coalesce(F.nullif(F.stddev_pop(trained(c)), F.lit(0.0)), F.lit(1.0))
    facts = [f(trained(c)).alias(f"{kind}_{c}") for c in regressors for kind, f in (("mean", F.avg),)] + [wide(c).alias(f"width_{c}") for c in regressors]
    per = newest(frame, MEMORY).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("_newest"), F.struct("t", "y")))).alias("rows"), F.first("border").alias("border"),
        F.avg("train_y").alias("level"), wide("train_y").alias("width"), F.count("train_y").cast("int").alias("m"), tests(regressors), *facts,
    )
    return per.where((F.size("tests") > 0) & (F.col("m") > 0)).select(
        *KEY, "border", "level", "width", "m", F.transform("rows", lambda r: r["y"]).alias("memory"),
        F.sort_array("tests").alias("tests"), F.array().cast("array<double>").alias("path"), *[f"{kind}_{c}" for c in regressors for kind in ("mean", "width")],
    )


def _step_features(state: DataFrame, step: int, regressors: list[str] = (), spec: dict | None = None) -> DataFrame:
    """Feature columns of one step from the values held in the state row."""
    wanted = set(feature_columns(regressors, spec))
    back = lambda n: F.try_element_at("memory", F.lit(-n))
    scale = lambda v: (v - F.col("level")) / F.col("width")
    out = state.withColumn("time_index", (F.col("m") + step - 1).cast("double"))
    lags, windows = (tuple(spec[k]) if spec else default for k, default in (("lags", LAGS), ("rolling_windows", ROLLING_WINDOWS)))
    for n in lags:
        out = out.withColumn(f"lag_{n}", F.coalesce(F.when(features.fits(F.col("m"), n, lags), scale(back(n))), F.lit(ABSENT)))
    for n in windows:
        mean = reduce(lambda a, b: a + b, [back(i) for i in range(1, n + 1)]) / n
        out = out.withColumn(f"rolling_mean_{n}", F.coalesce(F.when(features.fits(F.col("m"), n, windows), scale(mean)), F.lit(ABSENT)))
    row = F.element_at("tests", step)
    for c in regressors:
        out = out.withColumn(c, F.coalesce((row[c].cast("double") - F.col(f"mean_{c}")) / F.col(f"width_{c}"), F.lit(0.0)))
    for c, of in (("month", F.month), ("quarter", F.quarter)):
        if c in wanted:
            out = out.withColumn(c, of(row["ds"]).cast("double"))
    return out


def recurse(state: DataFrame, models: dict, horizons: dict, regressors: list[str] = (), spec: dict | None = None, cut_every: int = 4) -> DataFrame:
    """Forecast step by step, all keys and folds at once; every prediction becomes the next step's lag.

    Rows of each border go through their own model for a few steps; then all of
    them are written together, so jobs depend on the horizon alone.
    """
    columns = state.columns

    def moved(rows: DataFrame, model, first: int, last: int) -> DataFrame:
        for step in range(first, last + 1):
            ready = assembled(_step_features(rows.where(F.size("tests") >= step), step, regressors, spec), regressors, spec)
            value = F.element_at("memory", -1) + F.col("change") * F.col("width")
            longer = F.concat("memory", F.array(value))
            rows = model.transform(ready).withColumn("path", F.concat("path", F.array(value)))
            rows = rows.withColumn("memory", F.slice(longer, -F.least(F.size(longer), F.lit(MEMORY)), F.lit(MEMORY))).select(*columns)
        return rows

    done, last = [], max(horizons.values(), default=0)
    for first in range(1, last + 1, cut_every):
        parts = []
        for k, model in models.items():
            until = min(first + cut_every - 1, horizons[k])
            if until >= first:
                parts.append(moved(state.where(F.col("border") == k), model, first, until))
        state = stable(reduce(DataFrame.unionByName, parts))
        done.append(state.where(F.size("path") == F.size("tests")))
        state = state.where(F.size("path") < F.size("tests"))
    return reduce(DataFrame.unionByName, done)


def predict(
    frame: DataFrame, name: str, params: dict | None = None, horizon: int = 12, test_horizon: int = 3, regressors: list[str] = (), spec: dict | None = None,
    folds: list[int] | None = None,
) -> DataFrame:
    """Backtest and forward predictions of one tree family as long rows; `folds` restricts them."""
    if folds is not None:
        frame = frame.where(F.col("fold").isin(*folds))
    frame = spread(frame, "group_id")
    days = borders(frame)
    matrix = stable(training_rows(frame, regressors, days, spec))
    known = [r.border for r in matrix.select("border").distinct().orderBy("border").collect()]  # one row per border
    models = fit_borders(matrix, name, known, params, regressors, spec)
    horizons = {k: horizon if k == len(days) else test_horizon for k in known}
    starting = stable(states(with_border(frame, days), regressors))
    if not models:
        rows = starting.where("false").select(*KEY, F.inline(F.arrays_zip("tests", "path")))
    else:
        rows = recurse(starting, models, horizons, regressors, spec).select(*KEY, F.inline(F.arrays_zip("tests", "path")))
    return rows.select(
        "group_id", F.lit(name).alias("model_name"), "fold", F.col("tests.step").alias("step"), F.col("tests.ds").alias("ds"),
        F.col("tests.actual").alias("actual"), F.col("path").alias("value"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )


# -- importance: a pooled model's error, attributed per key -----------------------------


def gains(rows: DataFrame, score: Callable[[DataFrame], DataFrame], names: list[str], seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """Per row, seed and feature: how much the absolute error grows when the feature is shuffled inside the row's key.

    `rows` has one row per (group_id, t) with the features, `label` and
    `width`; `score` adds `change`, the predicted label in units of the width.
    A shuffle orders a key's rows by whole-number hashes of the seed and the
    position; one transform scores all features and seeds. Adds `p` and `c`, the row's position and
    its key's rows.
    """
    w = Window.partitionBy("group_id")
    placed = rows.withColumn("p", F.row_number().over(w.orderBy("t")) - 1).withColumn("c", F.count(F.lit(1)).over(w))
    error = F.abs(F.col("change") * F.col("width") - F.col("label"))
    based = score(placed.select("group_id", "t", "p", "c", "label", "width", *names)).withColumn("_error", error)
    based = stable(based.select("group_id", "p", "c", "label", "width", "_error", *names))
    values = F.struct(*names)
    seeded = based.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    seeded = seeded.withColumn("_h", draw(F.col("seed"), F.col("p") + 1, 8, F.lit(2_000_000_000), 42))
    turn = Window.partitionBy("group_id", "seed").orderBy("_h", "p")
    other = seeded.select("group_id", "seed", (F.row_number().over(turn) - 1).alias("p"), values.alias("_other"))
    cases = seeded.join(other, ["group_id", "seed", "p"]).withColumn("feature", F.explode(F.array(*map(F.lit, names))))
    for f in names:
        cases = cases.withColumn(f, F.when(F.col("feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)))
    scored = score(cases.drop("_other", "_h")).withColumn("gain", error - F.col("_error"))
    return scored.select("group_id", "p", "c", "seed", "feature", "gain")


def attributed(found: DataFrame, name: str, options: Importance = Importance()) -> dict[str, DataFrame]:
    """Point, window (resamples and segments) and horizon (tails) vectors of every key from its row gains.

    A weight is the mean gain of a feature over the vector's rows, 0 at least,
    as a share of the vector. No model is fitted again: a resample counts a row as often as it is drawn.
    """
    # By key from here on: every later sum is finished inside a task but for a row per key, vector and feature.
    per_row = stable(spread(found, "group_id").groupBy("group_id", "p", "c", "feature").agg(F.avg("gain").alias("gain")))

    def vectors(rows: DataFrame, label: Column, times: Column = F.lit(1)) -> DataFrame:
        made = rows.withColumn("vector_id", label).where(F.col("vector_id").isNotNull())
        weight = F.greatest(F.lit(0.0), F.sum(F.col("gain") * times) / F.sum(times))
        made = made.groupBy("group_id", "vector_id", "feature").agg(weight.alias("weight"))
        return importance.normalised(made.select("group_id", F.lit(name).alias("model_name"), "vector_id", "feature", "weight"))

    at, size = F.col("p"), F.col("c")
    point = vectors(per_row, F.lit("point"))
    # What a resample draws follows from the number of rows alone: a row per length that occurs, resample and position, bounded by the calendar.
    place = F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))
    drawn = per_row.select("c").distinct().withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(options.resamples - 1)))).withColumn("at", place)
    drawn = drawn.select("c", "resample", draw(F.col("resample"), F.col("at"), 7, F.col("c")).alias("p")).groupBy("c", "resample", "p").agg(F.count(F.lit(1)).alias("times"))
    window = vectors(per_row.join(F.broadcast(drawn), ["c", "p"]), F.concat(F.lit("resample_"), F.col("resample").cast("string")), F.col("times"))
    cut = importance.segment(at, size, options)
    window = window.unionByName(vectors(per_row, F.concat(F.lit("segment_"), cut.cast("string"))))
    tails = [vectors(per_row.where(importance.in_tail(at, size, f, options)), F.lit(f"tail_{f}")) for f in options.fractions]
    return {"point": point, "window": window, "horizon": reduce(DataFrame.unionByName, tails)}


def held_back(matrix: DataFrame, options: Importance = Importance()) -> Column:
    """Rows of a key's newest holdout: a fifth of its rows, 3 to 12 of them; null where the key is too short to hold any out."""
    w = Window.partitionBy("group_id")
    back, size = F.row_number().over(w.orderBy(F.desc("t"))), F.count(F.lit(1)).over(w)
    holdout = F.least(F.greatest(F.lit(3), F.floor(size / 5)), F.lit(12))
    return F.when(size > holdout + options.min_rows, back <= holdout)


def importance_records(matrix: DataFrame, name: str, options: Importance = Importance(), regressors: list[str] = (), params: dict | None = None, spec: dict | None = None) -> DataFrame:
    """One importance record per group, of its own rows under the pooled model.

    With `options.holdout` the model is fitted without each key's newest rows and
    the shuffles happen there, over the seeds of `options.seeds`; keys too short to
    hold rows out have no record.
    """
    names = feature_columns(regressors, spec)
    if options.holdout:
        marked = stable(matrix.withColumn("_held", held_back(matrix, options)))
        learnt, judged, seeds, method = marked.where("_held IS NULL OR NOT _held"), marked.where("_held"), options.seeds, "permutation"
    else:
        learnt, judged, seeds, method = matrix, matrix, options.seeds[:1], "native_importance"
    model = estimator(name, params).fit(assembled(learnt, regressors, spec))
    made = attributed(gains(judged, lambda rows: model.transform(assembled(rows, regressors, spec)), names, seeds), name, options)
    correlated = importance.feature_correlations(matrix, ["group_id"], names, "y")
    return importance.assemble(made["point"].drop("vector_id"), correlated, made["window"], made["horizon"], options, method)


# -- parameter search -----------------------------------------------------------------


def settings_tried(name: str, options: Search) -> list[dict]:
    """The default first, then distinct seeded draws from the family's space, `trials` in all."""
    space, draws = SEARCH[name], random.Random(options.seed)
    size = reduce(lambda a, b: a * b, map(len, space.values()))
    tried = [dict(DEFAULTS[name])]
    for place in draws.sample(range(size), size):
        chosen = {}
        for parameter, values in space.items():
            place, at = divmod(place, len(values))
            chosen[parameter] = values[at]
        if len(tried) < options.trials and {**DEFAULTS[name], **chosen} != {**DEFAULTS[name], **tried[0]}:
            tried.append(chosen)
    return tried


def search(matrix: DataFrame, name: str, options: Search = Search(), regressors: list[str] = (), spec: dict | None = None) -> DataFrame:
    """Successive halving over settings: a row per (setting, split) that was fitted, with its MAE and whether the setting went on.

    Splits are calendar dates, each with all earlier rows to learn from and the
    rows up to the next date to judge; keys with enough rows take part. All
    settings see the first split, the better half the next one, and so on;
    fits of one split run side by side. `place` orders the settings that saw every split by their mean
    MAE, the default setting (trial 0) first among equals.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    rows = stable(matrix.withColumn("_c", size).where(F.col("_c") >= options.min_rows).withColumn("_day", F.unix_date(F.col("ds").cast("date"))))
    spark: SparkSession = matrix.sparkSession
    schema = "model_name string, trial int, params string, split int, mae double, went_on boolean, place int"
    shares = [k / (options.splits + 1) for k in range(1, options.splits + 1)]
    cuts = rows.agg(F.percentile("_day", F.array(*map(F.lit, shares))).alias("cuts")).first().cuts
    if not cuts:
        return spark.createDataFrame([], schema)
    tried = settings_tried(name, options)
    alive, found = list(range(len(tried))), {}
    for split, cut in enumerate(cuts):
        until = cuts[split + 1] if split + 1 < len(cuts) else None
        learnt = rows.where(F.col("_day") <= cut)
        judged = rows.where((F.col("_day") > cut) & (F.lit(True) if until is None else F.col("_day") <= until))

        def mae(trial: int) -> Callable:
            def run() -> float | None:
                model = estimator(name, tried[trial]).fit(assembled(learnt, regressors, spec))
                return model.transform(assembled(judged, regressors, spec)).agg(F.avg(F.abs(F.col("change") - F.col("scaled_label")))).first()[0]

            return run

        for trial, error in zip(alive, together([mae(t) for t in alive]), strict=True):
            found[trial, split] = error
        mean = lambda t: sum(found[t, s] or 0.0 for s in range(split + 1)) / (split + 1)
        kept = sorted(alive, key=lambda t: (mean(t), t))
        alive = kept if split + 1 == len(cuts) else kept[: max(1, (len(kept) + 1) // 2)]
    place = {t: i + 1 for i, t in enumerate(alive)}
    table = [(name, t, json.dumps(tried[t], sort_keys=True), s, error, (t, s + 1) in found or t in place, place.get(t)) for (t, s), error in sorted(found.items())]
    return spark.createDataFrame(table, schema)  # trials times splits, a few dozen rows


def tuned(trials: DataFrame, name: str, options: Search = Search()) -> tuple[dict, bool, str]:
    """The setting to fit with, whether a search chose it, and why."""
    best = trials.where("place = 1").select("params", "mae").first()
    if best is None:
        return dict(DEFAULTS[name]), False, f"No series has the {options.min_rows} rows that a search needs."
    return json.loads(best.params), True, f"Best of {trials.select('trial').distinct().count()} settings over up to {options.splits} splits."
