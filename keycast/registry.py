"""What a run picks up besides its own parts: models, plausibility rules, drift statistics and nulls.

Registering adds to every later run of this driver; `withdraw` takes a name out
again. Everything registered works on whole DataFrames or column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from keycast import config
from keycast.config import ConfigurationError, ModelSpec, Rules

# name → predict(frame, regressors): rows of group_id, model_name, fold, step, ds, actual, value, lower, upper.
FORECASTERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}
# rule id → (reason, build): build(rules) gives the failure condition and the measure over `rules.forecast_facts` rows.
RULES: dict[str, tuple[str, Callable[[Rules], tuple[Column, Column]]]] = {}
# name → statistic of two sorted array columns, given by name.
STATISTICS: dict[str, Callable[[str, str], Column]] = {}
# method → array of (iteration, a, b) from the `history` array and its size.
NULLS: dict[str, Callable[[Column], Column]] = {}


def register_model(spec: ModelSpec, predict: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    """A candidate of every run that does not name its models; it ranks after the built-in ones on ties."""
    _new(spec.name, {m.name for m in (*config.MODELS, *config.EXTRA_MODELS)})
    config.EXTRA_MODELS.append(spec)
    FORECASTERS[spec.name] = predict


def register_rule(rule_id: str, reason: str, build: Callable[[Rules], tuple[Column, Column]]) -> None:
    """One more plausibility rule; a null condition passes."""
    _new(rule_id, {*config.REASONS, *RULES})
    RULES[rule_id] = (reason, build)


def register_statistic(name: str, build: Callable[[str, str], Column]) -> None:
    """A two-sample statistic that `Drift.algorithm` may name."""
    _new(name, set(STATISTICS))
    STATISTICS[name] = build


def register_null(method: str, build: Callable[[Column], Column]) -> None:
    """A way to cut a history into compared parts that `Drift.method` may name; its 95th percentile is the threshold."""
    _new(method, {"auto", "percentile", "bootstrap", "kernel_density", *NULLS})
    NULLS[method] = build


def withdraw(name: str) -> None:
    config.EXTRA_MODELS[:] = [m for m in config.EXTRA_MODELS if m.name != name]
    for held in (FORECASTERS, RULES, STATISTICS, NULLS):
        held.pop(name, None)


def _new(name: str, taken: set[str]) -> None:
    if name in taken:
        raise ConfigurationError(f"{name!r} is registered already.")
