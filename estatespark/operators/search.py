"""Settings drawn for a random search, and the best of its runs."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping
from dataclasses import fields, replace

from pyspark.sql import DataFrame

from estatespark.config import RunConfig
from estatespark.operators.metrics import best_run


def sample_settings(space: Mapping[str, Mapping], n: int, seed: int = 0) -> list[dict]:
    """`n` settings drawn from a search space of constants, value lists and ranges.

    A parameter is {"value": v}, {"values": [...]}, or {"min": a, "max": b} with a `distribution` of "uniform", "int_uniform"
    or "log_uniform_values". Bounds may come in either order.
    """
    rng = random.Random(seed)
    return [{name: _draw(rng, name, spec) for name, spec in sorted(space.items())} for _ in range(n)]


def _draw(rng: random.Random, name: str, spec: Mapping):
    if "value" in spec:
        return spec["value"]
    if "values" in spec:
        return rng.choice(list(spec["values"]))
    low, high = sorted((spec["min"], spec["max"]))
    kind = spec.get("distribution", "uniform")
    if kind == "int_uniform":
        return rng.randint(int(low), int(high))
    if kind == "log_uniform_values":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    if kind == "uniform":
        return rng.uniform(low, high)
    raise ValueError(f"unknown distribution {kind!r} of {name}")


def apply_settings(config: RunConfig, settings: Mapping) -> RunConfig:
    """A run's settings with drawn values; names that no part of the run takes are refused."""
    known = {f.name for f in fields(RunConfig)}
    unknown = sorted(set(settings) - known)
    if unknown:
        raise ValueError(f"settings that the run does not take: {unknown}")
    return replace(config, **{k: v for k, v in settings.items()})


def best_trial(trials: DataFrame, metric: str = "MAPE_valid") -> DataFrame:
    """The trial with the lowest metric; ties go to the smaller name."""
    return best_run(trials.where(trials["metric"] == metric), "value")
