"""Photo geometry as column arithmetic; pixel work as Arrow batches of numpy, split by Spark over the photos."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks receive these functions by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Channel means and deviations (red, green, blue) of the usual normalisation, padding grey level.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
PADDING = 255


def resize_geometry(width: Column, height: Column, target: int) -> dict[str, Column]:
    """Size and margins that bring a photo to a target square: the shorter side becomes `target`.

    The margins are zero or negative: what sticks out of the square is cut off on both sides.
    """
    ratio = width.cast("double") / height.cast("double")
    wide = ratio > 1
    new_width = F.when(wide, F.floor(F.lit(target) * ratio)).otherwise(F.lit(target)).cast("bigint")
    new_height = F.when(wide, F.lit(target)).otherwise(F.floor(F.lit(target) / ratio)).cast("bigint")
    left, top = F.floor((F.lit(target) - new_width) / 2), F.floor((F.lit(target) - new_height) / 2)
    return {
        "new_width": new_width,
        "new_height": new_height,
        "pad_left": left,
        "pad_top": top,
        "pad_right": F.lit(target) - new_width - left,
        "pad_bottom": F.lit(target) - new_height - top,
    }


def with_geometry(df: DataFrame, target: int | None = 128, im_size: tuple[int, int] = (128, 128)) -> DataFrame:
    """Adds the geometry columns. Without a positive target the photo is stretched to `im_size` (height, width)."""
    if target is not None and target > 0:
        return df.withColumns(resize_geometry(F.col("width"), F.col("height"), target))
    fixed = {"new_width": im_size[1], "new_height": im_size[0]}
    fixed.update(dict.fromkeys(("pad_left", "pad_top", "pad_right", "pad_bottom"), 0))
    return df.withColumns({name: F.lit(value).cast("bigint") for name, value in fixed.items()})


@lru_cache(maxsize=4096)
def _weights(old: int, new: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours and share of the second one, of the new pixels from `first` up to `last`."""
    centre = np.clip((np.arange(first, last) + 0.5) * (old / new) - 0.5, 0, old - 1)
    low = np.floor(centre).astype(int)
    return low, np.minimum(low + 1, old - 1), centre - low


def bilinear(
    pixels: np.ndarray, height: int, width: int, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None
) -> np.ndarray:
    """(..., h, w, c) resampled to (..., height, width, c) between pixel centres, or to the `rows` and `columns` of that alone."""
    top, bottom, down = _weights(pixels.shape[-3], height, *(rows or (0, height)))
    left, right, across = _weights(pixels.shape[-2], width, *(columns or (0, width)))
    across, down = across[None, :, None], down[:, None, None]

    def between(line: np.ndarray) -> np.ndarray:
        taken = pixels[..., line, :, :]
        return taken[..., left, :] * (1 - across) + taken[..., right, :] * across

    return between(top) * (1 - down) + between(bottom) * down


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of pixels as Spark's image source stores them (grey, or blue-green-red with an optional alpha)."""
    return _rgb(np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels))


def _rgb(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(pixels, 3, axis=-1) if pixels.shape[-1] == 1 else pixels[..., 2::-1]


def normalise(pixels: np.ndarray) -> np.ndarray:
    return (pixels / 255.0 - np.asarray(CHANNEL_MEAN)) / np.asarray(CHANNEL_STD)


# Height, width, channels, then the columns of `with_geometry`: photos with the same ones are resized together.
SHAPE = ("height", "width", "n_channels", "new_height", "new_width", "pad_left", "pad_top", "pad_right", "pad_bottom")
# Numbers that are worked on at once.
NUMBERS_AT_ONCE = 2_000_000


def _cut(pixels: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """(n, h, w, c) of one shape at the target size. Only what stays inside the square is resampled."""
    new_height, new_width, left, top, right, bottom = shape[3:]
    rows, columns = (max(-top, 0), new_height - max(-bottom, 0)), (max(-left, 0), new_width - max(-right, 0))
    resized = bilinear(pixels.astype(np.float64), new_height, new_width, rows, columns)
    # A margin of one pixel can be positive after rounding.
    margins = ((0, 0), (max(top, 0), max(bottom, 0)), (max(left, 0), max(right, 0)), (0, 0))
    return np.pad(resized, margins, constant_values=PADDING) if any(map(any, margins)) else resized


def resize_photos(
    images: DataFrame, target: int | None = 128, im_size: tuple[int, int] = (128, 128), norm_image: bool = False
) -> DataFrame:
    """Decoded photos at the target size, red-green-blue, as a flat array `pixels` (height, width, channel order).

    Pixels are rounded to whole grey levels; with `norm_image` they are floats, scaled and normalised per channel.
    """
    passed = [f for f in images.schema.fields if f.name not in ("data", "height", "width", "n_channels")]
    schema = T.StructType(
        passed
        + [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]
        + [T.StructField("pixels", T.ArrayType(T.FloatType() if norm_image else T.ShortType()))]
    )
    names = [f.name for f in passed]

    def resized(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shapes = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in SHAPE], axis=1).astype(np.int64)
        data = batch.column("data")
        kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(kind.ravel(), minlength=len(kinds)))
        for shape, places in zip(map(tuple, kinds.tolist()), np.split(order, ends[:-1])):
            height, width, channels = shape[:3]
            most = max(1, NUMBERS_AT_ONCE // max(1, height * width * 3, shape[3] * shape[4] * 3))
            for start in range(0, len(places), most):
                chosen = pa.array(places[start : start + most])
                raw = b"".join(v.as_py() for v in data.take(chosen))
                photos = _rgb(np.frombuffer(raw, dtype=np.uint8).reshape(len(chosen), height, width, channels))
                out = np.floor(_cut(photos, shape) + 0.5)
                flat = (normalise(out).astype(np.float32) if norm_image else out.astype(np.int16)).reshape(len(out), -1)
                offsets = np.arange(len(out) + 1, dtype=np.int32) * flat.shape[1]
                sides = [pa.array(np.full(len(out), side, np.int32)) for side in out.shape[1:3]]
                kept = [batch.column(n).take(chosen) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *sides, pa.ListArray.from_arrays(offsets, flat.ravel())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # Photos of rare shapes would be batches of their own, each with the cost of one.
                yield from pa.Table.from_batches(resized(batch)).combine_chunks().to_batches(max_chunksize=1000)

    with_size = with_geometry(images, target, im_size)
    # Arrow batches are bounded in bytes by the session (64 MB by default), whatever the photo size.
    return with_size.mapInArrow(run, schema)


def colour_summary() -> Callable[[np.ndarray], np.ndarray]:
    """Default photo vector: mean, deviation and an 8-bin histogram of each channel, of pixels in 0..255."""

    def embed(pixels: np.ndarray) -> np.ndarray:
        scaled = pixels / 255.0
        bins = [np.bincount(np.minimum(pixels[:, :, c] // 32, 7).astype(int).ravel(), minlength=8) for c in range(3)]
        shares = np.concatenate(bins) / (pixels.shape[0] * pixels.shape[1])
        return np.concatenate([scaled.mean(axis=(0, 1)), scaled.std(axis=(0, 1)), shares])

    return embed


def embed_photos(
    images: DataFrame, loader: Callable[[], Callable[[np.ndarray], np.ndarray]] = colour_summary, vector: str = "vector"
) -> DataFrame:
    """A vector per photo from a user's function. `loader` runs once per task and returns that function."""
    passed = [f for f in images.schema.fields if f.name not in ("data", "height", "width", "n_channels")]
    schema = T.StructType(passed + [T.StructField(vector, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in passed]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = loader()
        for batch in batches:
            rows = [
                (*[getattr(r, n) for n in names], np.asarray(embed(rgb(r.data, r.height, r.width, r.n_channels)), dtype=float))
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return images.mapInPandas(run, schema)

