"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score). One weight per hashed feature is shared by all grades; the thresholds are ordered by
construction, each a positive step above the one before. The score gives the expected grade and the tail probability
P(grade >= level) that selects documents.

Features are text hashed in three ways: runs of 1 to 4 characters of the text's outline (letters stand for their kind and repeats of a
kind are one, so the outline is the same in all languages), and tokens for the length and for how much words and lines repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import as_bytes, small_batches, unused
from estatespark.llm.fitting import adam, labelled_sample, sigmoid
from estatespark.llm.hashed_text import gram_codes, slices
from estatespark.llm.jaccard_join import WordCodes, shingles

GRAMS = (1, 2, 3, 4)
BITS = 14
SLICE = 1 << 20
# Bound of the sample that the model is fitted on: this many labelled rows of each grade.
ROWS_PER_GRADE = 4000
PENALTY, RATE, STEPS = 1e-5, 0.1, 150
TOKEN_VALUE = 0.5

OUTLINE = np.arange(256, dtype=np.uint8)
OUTLINE[ord("a") : ord("z") + 1] = ord("a")
OUTLINE[128:] = ord("a")
OUTLINE[ord("A") : ord("Z") + 1] = ord("A")
OUTLINE[ord("0") : ord("9") + 1] = ord("0")


def _token(name: str, bucket: int) -> int:
    return zlib.crc32(f"{name}:{bucket}".encode()) & ((1 << BITS) - 1)


class Features:
    """(codes, values) of a whole text: outline runs with the root of their counts, of length one, and three tokens."""

    def __init__(self):
        self.words = WordCodes()

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        outline = OUTLINE[np.frombuffer(text, np.uint8)]
        if len(outline):
            letter = (outline == ord("a")) | (outline == ord("A"))
            outline = outline[np.r_[True, (outline[1:] != outline[:-1]) | ~letter[1:]]]
        counts = np.zeros(1 << BITS)
        for start, end in slices(len(outline), SLICE, max(GRAMS) - 1):
            counts += np.bincount(gram_codes(outline[start:end], GRAMS, BITS), minlength=1 << BITS)
        codes = np.flatnonzero(counts)
        values = np.sqrt(counts[codes])
        values /= max(1e-9, float(np.sqrt((values * values).sum())))
        n_words = len(text.split())
        lines = [line for line in text.split(b"\n") if line.strip()]
        repeat = 10 * len(shingles(text, 3, self.words)) // max(1, n_words - 2)
        tokens = [
            _token("length", min(12, n_words.bit_length())),
            _token("words", repeat),
            _token("lines", 10 * len(set(lines)) // max(1, len(lines))),
        ]
        return np.r_[codes, tokens].astype(np.int64), np.r_[values, np.full(len(tokens), TOKEN_VALUE)]


@dataclass(frozen=True)
class OrdinalModel:
    """`weights` has 2**BITS entries for any corpus; `thresholds` one entry less than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def transform(
        self, docs: DataFrame, text_column: str = "text", level: int = 1, output: tuple[str, str] = ("expected_grade", "tail_probability")
    ) -> DataFrame:
        """`docs` with the expected grade and the chance of grades `level` and above, over whole texts.

        Missing and empty texts are scored by their features of no text. Rows come out as often as they come in; further columns named
        like the output are replaced, an empty table stays one.
        """
        if not 1 <= level <= len(self.thresholds):
            raise ValueError("level is a grade above the lowest")
        small_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.thresholds))
        # Only the texts go to Python, and two numbers come back.
        graded = F.arrow_udf(_grades(shared, level), "expected double, tail double")(F.col(f"`{text_column}`"))
        kept, packed = [c for c in docs.columns if c not in output], unused(docs.columns, "graded")
        grades = docs.select(*[F.col(f"`{c}`") for c in kept], graded.alias(packed))
        named = [F.col(packed).getField(part).alias(name) for part, name in zip(("expected", "tail"), output)]
        return grades.select(*[F.col(f"`{c}`") for c in kept], *named)


def _grades(shared, level: int) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, thresholds = shared.value
        features = Features()
        for texts in batches:
            found = map(features, as_bytes(texts))
            scores = np.array([float(weights[codes] @ values) for codes, values in found], np.float64)
            above = 1.0 - sigmoid(thresholds[None, :] - scores[:, None])
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(np.ascontiguousarray(above[:, level - 1]))], names=["expected", "tail"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]):
    features = Features()
    for batch in batches:
        found = [features(text) for text in as_bytes(batch.column(2))]
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array([c.astype(np.int32).tobytes() for c, _ in found], pa.binary()),
            pa.array([v.tobytes() for _, v in found], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "codes", "values"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_column: str = "doc_id", text_column: str = "text",
    rows_per_grade: int = ROWS_PER_GRADE,
) -> OrdinalModel:
    """Fits grades 0 .. `grades` - 1 on at most `rows_per_grade` labelled rows of each; their share comes from all labels.

    Missing grades are left out. Without labelled texts every document gets the same score, and the thresholds are those
    of equal shares.
    """
    if grades < 2:
        raise ValueError("two grades are needed at least")
    counted = labels.groupBy(grade.cast("int").alias("grade")).agg(F.count("*").alias("n")).collect()
    share = np.array([{r["grade"]: r["n"] for r in counted}.get(g, 0) for g in range(grades)], np.float64)
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, grade, list(range(grades)), rows_per_grade, id_column, text_column)
    schema = f"key {sample.schema['key'].dataType.simpleString()}, label int, codes binary, values binary"
    # Sorted, so that the sums of the fit do not depend on which task came first.
    found = sample.mapInArrow(_sampled, schema).toArrow().sort_by("key")
    label = found.column("label").to_numpy().astype(np.int64)
    cumulative = np.cumsum(share + 1.0)[:-1] / (share + 1.0).sum()
    start = np.log(cumulative) - np.log1p(-cumulative)
    size = 1 << BITS
    if not len(label):
        return OrdinalModel(np.zeros(size), start)
    groups = [np.frombuffer(b, np.int32) for b in found.column("codes").to_pylist()]
    codes = np.concatenate(groups)
    values = np.concatenate([np.frombuffer(b, np.float64) for b in found.column("values").to_pylist()])
    row = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    sampled = np.bincount(label, minlength=grades)
    # Each grade weighs as much as its share of all labels.
    weight = (share / np.maximum(sampled, 1))[label]
    weight /= weight.sum()

    def cuts(at: np.ndarray) -> np.ndarray:
        return at[size] + np.r_[0.0, np.cumsum(np.exp(at[size + 1 :]))]

    def gradient(at: np.ndarray) -> np.ndarray:
        weights, bounds = at[:size], np.r_[-np.inf, cuts(at), np.inf]
        scores = np.bincount(row, weights=values * weights[codes], minlength=len(label))
        upper, lower = sigmoid(bounds[label + 1] - scores), sigmoid(bounds[label] - scores)
        chance = np.maximum(upper - lower, 1e-12)
        rise, fall = upper * (1 - upper) / chance * weight, lower * (1 - lower) / chance * weight
        slope = np.bincount(codes, weights=values * (rise - fall)[row], minlength=size) + PENALTY * weights
        by_cut = np.bincount(label, weights=-rise, minlength=grades)[:-1] + np.bincount(label, weights=fall, minlength=grades)[1:]
        steps = np.cumsum(by_cut[::-1])[::-1]
        return np.r_[slope, by_cut.sum(), steps[1:] * np.exp(at[size + 1 :])]

    begin = np.r_[np.zeros(size), start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    fitted = adam(gradient, begin, STEPS, RATE)
    return OrdinalModel(fitted[:size], cuts(fitted))
