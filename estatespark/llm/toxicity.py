"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams, A-Z lower-cased and white space unified. Each gram's weight is its log ratio of document
frequencies in the two classes times a weight fitted by logistic regression. The fitted weights go with the ratios themselves, so
grams that say little count by the square of it and don't add up to a verdict in long texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import as_bytes
from estatespark.llm.fitting import descend, labelled_sample, sigmoid
from estatespark.llm.hashed_text import Distinct, gram_codes, slices

GRAMS = (3, 4, 5)
BITS = 18
SLICE = 1 << 20
# Bound of the sample that the model is fitted on: this many labelled rows of each class.
ROWS_PER_CLASS = 2000
PENALTY, RATE, STEPS = 1e-4, 0.1, 150
# Codes that the fit takes up at once.
BLOCK = 1 << 20


class Grams:
    """Distinct codes of a text's grams, over its whole length."""

    def __init__(self):
        self.distinct = Distinct(BITS)

    def __call__(self, text: bytes | None) -> np.ndarray:
        plain = b" " + (text or b"").lower() + b" "
        letters = np.frombuffer(plain, np.uint8)
        letters = np.where((letters >= 9) & (letters <= 13), np.uint8(32), letters)
        if len(letters) <= SLICE:
            return self.distinct(gram_codes(letters, GRAMS, BITS))
        seen = np.zeros(1 << BITS, bool)
        for start, end in slices(len(letters), SLICE, max(GRAMS) - 1):
            seen[gram_codes(letters[start:end], GRAMS, BITS)] = True
        return np.flatnonzero(seen)


@dataclass(frozen=True)
class ToxicityModel:
    """`weights` has 2**BITS entries for any corpus."""

    weights: np.ndarray
    intercept: float

    def transform(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(id, score): probability of label 1 for every whole text. Missing and empty texts have the score of no evidence."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weights.astype(np.float32), self.intercept))
        narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        kind = narrow.schema["id"].dataType.simpleString()
        return narrow.mapInArrow(_scores(shared), f"id {kind}, score double").withColumnRenamed("id", id_column)


def _scores(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        weights, intercept = shared.value
        grams = Grams()
        for batch in batches:
            totals = [float(weights[grams(text)].sum(dtype=np.float64)) for text in as_bytes(batch.column(1))]
            scores = sigmoid(np.array(totals, np.float64) + intercept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]):
    grams = Grams()
    for batch in batches:
        packed = [grams(text).astype(np.int32).tobytes() for text in as_bytes(batch.column(2))]
        columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "grams"])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text",
    rows_per_class: int = ROWS_PER_CLASS,
) -> ToxicityModel:
    """Fits on at most `rows_per_class` labelled rows of each class; the share of the classes comes from all labels.

    Labels that are missing are left out. Without labelled texts of both classes the score is the smoothed share of label 1.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy(F.col(label_column).alias("label")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((ones + 1.0) / (zeros + 1.0)))
    sample = labelled_sample(docs, labels, F.col(label_column), [0, 1], rows_per_class, id_column, text_column)
    schema = f"key {sample.schema['key'].dataType.simpleString()}, label int, grams binary"
    # Sorted, so that the sums of the fit do not depend on which task came first.
    found = sample.mapInArrow(_sampled, schema).toArrow().sort_by("key")
    label = found.column("label").to_numpy().astype(np.float64)
    if not (label == 1).any() or not (label == 0).any():
        return ToxicityModel(np.zeros(1 << BITS), prior)
    # Texts are taken up in blocks, so that what the fit needs beside the codes stays small.
    blocks: list[tuple[np.ndarray, np.ndarray, slice]] = []
    held, first = [], 0
    for i, grams in enumerate(found.column("grams").to_pylist()):
        held.append(np.frombuffer(grams, np.int32))
        if i + 1 == len(label) or sum(map(len, held)) > BLOCK:
            blocks.append((np.concatenate(held), np.array([len(h) for h in held]), slice(first, i + 1)))
            held, first = [], i + 1
    del found
    size = 1 << BITS

    def spread(values: np.ndarray) -> np.ndarray:
        """For each code the sum of the values of the texts that hold it."""
        total = np.zeros(size)
        for codes, lengths, texts in blocks:
            total += np.bincount(codes, weights=np.repeat(values[texts], lengths), minlength=size)
        return total

    def gathered(weights: np.ndarray) -> np.ndarray:
        """For each text the sum of the weights of its codes."""
        sums = [np.bincount(np.repeat(np.arange(len(n)), n), weights=weights[codes], minlength=len(n)) for codes, n, _ in blocks]
        return np.concatenate(sums)

    toxic, clean = spread(label), spread(1 - label)
    ratio = np.log((toxic + 1) / (label.sum() + 2)) - np.log((clean + 1) / ((1 - label).sum() + 2))
    # Both classes weigh the same in the fit; their real share comes back through the intercept.
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())

    def gradient(at: np.ndarray) -> np.ndarray:
        error = (sigmoid(gathered(ratio * at[:-1]) + at[-1]) - label) * weight
        return np.append(spread(error) * ratio + PENALTY * at[:-1], error.sum())

    fitted = descend(gradient, np.zeros(size + 1), STEPS, RATE)
    return ToxicityModel(ratio * fitted[:-1], float(fitted[-1]) + prior)
