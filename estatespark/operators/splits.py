"""Row splits decided by a hash of the key: no shuffle, no order, the same on every run and after a lost task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.functions.numeric import hash_bits
from estatespark.schema import IS_TEST, KEY

PARTS = 1000
# For shares that are no whole number of thousandths.
FINE_PARTS = 1_000_000
# Folds and samples must not follow the holdout, so they hash with other seeds.
FOLD_SEED_SHIFT = 1
SAMPLE_SEED_SHIFT = 2


def _drawn(seed: int, key: str) -> str:
    return f"{key}_hash_{seed}"


def draw_hashes(df: DataFrame, seeds: Sequence[int], key: str = KEY) -> DataFrame:
    """`df` with the key's hashes as columns. Splits that are given these rows read them instead of hashing the key again."""
    return df.withColumns({_drawn(seed, key): hash_bits(F.col(key), seed) for seed in seeds})


def drawn_hashes(df: DataFrame, key: str = KEY) -> list[str]:
    """The columns that `draw_hashes` has added."""
    return [c for c in df.columns if re.fullmatch(rf"{re.escape(key)}_hash_-?\d+", c)]


def hashed(seed: int, buckets: int, key: str = KEY, rows: DataFrame | None = None) -> Column:
    """Bucket of the key, from its drawn hash where `rows` have it."""
    drawn = rows is not None and _drawn(seed, key) in rows.columns
    return (F.col(_drawn(seed, key)) if drawn else hash_bits(F.col(key), seed)) % F.lit(buckets)


def _hashed_below(share: float, seed: int, key: str, rows: DataFrame | None = None) -> Column:
    if share > 0 and round(share * FINE_PARTS) == 0:
        raise ValueError(f"a share of {share} is below the finest split of 1/{FINE_PARTS}")
    parts = PARTS if abs(share * PARTS - round(share * PARTS)) < 1e-9 else FINE_PARTS
    return hashed(seed, parts, key, rows) < F.lit(round(share * parts))


def is_holdout(valid_size: float = 0.2, seed: int = 0, key: str = KEY, rows: DataFrame | None = None) -> Column:
    """True for the validation share of rows."""
    return _hashed_below(valid_size, seed, key, rows)


def is_fit(
    valid_size: float = 0.2, seed: int = 0, key: str = KEY, is_test: str = IS_TEST, rows: DataFrame | None = None
) -> Column:
    """True for rows that statistics and models may be fitted on: neither test nor validation."""
    return ~F.col(is_test) & ~is_holdout(valid_size, seed, key, rows)


def split_name(
    valid_size: float = 0.2, seed: int = 0, key: str = KEY, is_test: str = IS_TEST, rows: DataFrame | None = None
) -> Column:
    return F.when(F.col(is_test), "test").when(is_holdout(valid_size, seed, key, rows), "valid").otherwise("train")


def fold(n_folds: int = 3, seed: int = 0, key: str = KEY, rows: DataFrame | None = None) -> Column:
    return hashed(seed + FOLD_SEED_SHIFT, n_folds, key, rows)


def hash_sample(df: DataFrame, fraction: float = 0.01, seed: int = 0, key: str = KEY) -> DataFrame:
    return df.where(_hashed_below(fraction, seed + SAMPLE_SEED_SHIFT, key))


def aligned_sample(
    features: DataFrame, labels: DataFrame, fraction: float = 0.01, seed: int = 0, key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """A share of the feature rows, and the labels of exactly those rows."""
    sample = hash_sample(features, fraction, seed, key)
    # The same hash filters the labels before the join, so only the sampled share is shuffled.
    return sample, hash_sample(labels, fraction, seed, key).join(sample.select(key), key, "left_semi")


def union_splits(train: DataFrame, test: DataFrame, is_test: str = IS_TEST) -> DataFrame:
    """Both tables as one, flagged; duplicates stay."""
    return train.withColumn(is_test, F.lit(False)).unionByName(
        test.withColumn(is_test, F.lit(True)), allowMissingColumns=True
    )


def cut_splits(df: DataFrame, is_test: str = IS_TEST) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col(is_test)).drop(is_test), df.where(F.col(is_test)).drop(is_test)


def join_labels(listings: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Prices by key; listings without a label, such as test rows, get NULL."""
    return listings.join(labels, key, "left")
