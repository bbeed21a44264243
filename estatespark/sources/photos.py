"""Photo folders as tables. Paths look like <split>/ann_<id>/<name>.jpg."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from estatespark.schema import KEY

# Folder name of a listing, kept file ending.
FOLDER = r"(?:^|/)ann_(\d+)/[^/]+$"
SUFFIX = ".jpg"
SPLIT = r"([^/]+)/ann_\d+/[^/]+$"


def parse_photo_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds listing id, split and file name of photo files; other files and loose files are dropped."""
    ident = F.regexp_extract(path, FOLDER, 1)
    return df.where(F.col(path).endswith(SUFFIX) & (ident != "")).withColumns(
        {
            KEY: ident.cast("bigint"),
            "split": F.regexp_extract(path, SPLIT, 1),
            "name": F.regexp_extract(path, r"([^/]+)$", 1),
        }
    )


def read_photos(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """One row per photo under `root`. Without `content` the files are listed, not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", True).load(root)
    )
    return parse_photo_paths(files.select("path", "content") if content else files.select("path"))


def decode_photos(spark: SparkSession, root: str, counted: Observation | None = None) -> DataFrame:
    """Decoded photos: key, split, name, height, width, n_channels and rows of pixels (`data`, blue-green-red).

    Decoding runs on the JVM. Files that are not images are left out; `counted` learns how many of each kind there were
    (`n_photos`, `n_undecoded`) when the photos are used.
    """
    images = (
        spark.read.format("image")
        .option("pathGlobFilter", f"*{SUFFIX}")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return _decoded(images, counted)


# Characters that a path would be matched by.
PATTERN_SIGNS = r"([\\{}\[\]*?^])"


def decode_files(spark: SparkSession, paths: list[str], counted: Observation | None = None) -> DataFrame:
    """The photos at the given paths, as `decode_photos` gives them; no other file is read."""
    return _decoded(spark.read.format("image").load([re.sub(PATTERN_SIGNS, r"\\\1", path) for path in paths]), counted)


def _decoded(images: DataFrame, counted: Observation | None) -> DataFrame:
    flat = images.select(
        # The origin is spelled as a URL, in which a plus is a plus.
        F.url_decode(F.regexp_replace("image.origin", r"\+", "%2B")).alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )
    photos = parse_photo_paths(flat)
    broken = F.col("height") < 0
    if counted is not None:
        photos = photos.observe(counted, F.count("*").alias("n_photos"), F.count(F.when(broken, 1)).alias("n_undecoded"))
    return photos.where(~broken)


def photo_dims(images: DataFrame) -> DataFrame:
    """Width, height and channels of decoded photos; the pixels are pruned from the scan's output."""
    keep = [c for c in (KEY, "split", "name", "photo_no") if c in images.columns]
    return images.select(*keep, "width", "height", "n_channels")
