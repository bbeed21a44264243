"""Small fits on bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch gradient descent with adaptive steps; the same input gives the same result."""
    at, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        slope = gradient(at)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        at -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return at


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float, momentum: float = 0.9) -> np.ndarray:
    """Full-batch gradient descent with momentum, which looks ahead. A weight moves as far as the rows ask for, so weights that
    explain little stay little.
    """
    at, pace = start.copy(), np.zeros_like(start)
    for _ in range(steps):
        pace = momentum * pace - rate * gradient(at + momentum * pace)
        at += pace
    return at


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, classes: list[int], rows_per_class: int, id_column: str, text_column: str
) -> DataFrame:
    """(label, text) of at most `rows_per_class` labelled rows of each class, the ones with the smallest hashed ids.

    The sample's keys are the only thing broadcast: rows_per_class * len(classes) of them at most.
    """
    known = labels.select(F.col(id_column).alias("key"), label.cast("int").alias("label")).where("key is not null")
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(rows_per_class) for c in classes]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    texts = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(chosen.distinct()), "key").select("key", "label", "text")
