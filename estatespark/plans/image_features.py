"""Photo folders to one feature vector per listing and split."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from estatespark.operators import pixels, vectors
from estatespark.schema import KEY
from estatespark.session import as_table
from estatespark.sources import photos, sinks


def listing_vectors(
    images: DataFrame, loader: Callable[[], Callable[[np.ndarray], np.ndarray]] = pixels.colour_summary
) -> DataFrame:
    """(split, key, vector): the mean of the photos' vectors."""
    embedded = pixels.embed_photos(images, loader).select(F.struct("split", KEY).alias("owner"), "vector")
    means = vectors.vector_mean(embedded, "owner", "vector")
    return means.select(F.col("owner.split").alias("split"), F.col(f"owner.{KEY}").alias(KEY), "vector")


def extract_features(
    spark: SparkSession, root: str, path: str, loader: Callable[[], Callable[[np.ndarray], np.ndarray]] = pixels.colour_summary
) -> dict[str, int]:
    """Reads the photo tree under `root`, writes wide feature tables per split.

    Returns the numbers of features, of photos, and of photos that could not be decoded.
    """
    counted = Observation("photos")
    packed = as_table(listing_vectors(photos.decode_photos(spark, root, counted), loader), "photo-vectors")
    size = packed.agg(F.max(F.size("vector"))).first()[0] or 0
    return {"n_features": sinks.write_features(vectors.widen(packed, "vector", size), path), **counted.get}
