"""Photos of a listing as a bounded, padded sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatespark.operators.projections import MAX_PHOTOS
from estatespark.schema import KEY


def photo_fallback(photos: DataFrame, split: str, fallback: str = "test", key: str = KEY) -> DataFrame:
    """Photos of the split's folder; listings without any there use the fallback folder."""
    primary = photos.where(F.col("split") == split)
    other = photos.where(F.col("split") == fallback)
    # Only keys are shuffled on the right side, once per listing.
    return primary.unionByName(other.join(primary.select(key).distinct(), key, "left_anti"))


def first_photos(photos: DataFrame, order: str, limit: int = MAX_PHOTOS, key: str = KEY) -> DataFrame:
    """The first photos of each listing, numbered from 0 in `position`.

    Spark keeps at most `limit` rows per listing in every task before the shuffle, so a listing may have any number of photos.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return photos.withColumn("position", number).where(F.col("position") <= limit).withColumn(
        "position", F.col("position") - 1
    )


def pad_sequences(first: DataFrame, value: str, zero: Column, length: int = MAX_PHOTOS, key: str = KEY) -> DataFrame:
    """(key, sequence, mask) with exactly `length` entries per listing; padding is `zero` and masked out.

    `first` holds at most `length` rows per listing, as `first_photos` gives them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("value"))))
    packed = first.groupBy(key).agg(ordered.alias("photos"))
    values = F.transform("photos", lambda p: p["value"])
    padded = F.slice(F.concat(values, F.array_repeat(zero, length)), 1, length)
    mask = F.slice(
        F.concat(F.transform("photos", lambda p: F.lit(1)), F.array_repeat(F.lit(0), length)), 1, length
    )
    return packed.select(key, padded.alias("sequence"), mask.alias("mask"))
