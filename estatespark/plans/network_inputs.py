"""Inputs of the neural models: prepared, scaled and coded rows, category sizes, photo sequences."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import encoding, pixels, projections, pseudo_labels, quantile_map, sequences, splits
from estatespark.schema import IS_TEST, KEY, TARGET
from estatespark.session import as_table, fresh_path, joinable
from estatespark.sources import photos


@dataclass(frozen=True)
class NetworkInputs:
    rows: DataFrame
    embeddings: DataFrame
    preprocessor: encoding.Preprocessor


def network_inputs(listings: DataFrame, config: RunConfig = RunConfig(), labels: DataFrame | None = None) -> NetworkInputs:
    """Rows of all splits: key, split, log price, codes (unknown = number of categories), scaled numbers.

    Test rows with an accepted pseudo label (`labels`: key, price, uncertainty) are fit rows as well, as rows of `train`.
    """
    if config.debug:
        listings = splits.hash_sample(listings, seed=config.seed)
    fitted = None
    if config.quantile_transform is not None:
        fitted = quantile_map.fit_quantile_map(
            listings.where(~F.col(IS_TEST)), n_quantiles=config.n_quantiles, output=config.quantile_transform
        )
    prepared = projections.prepare(listings, fitted, config.clip_rooms)
    # The split's hash is drawn once, not at each of the reads below.
    prepared = as_table(prepared.withColumn("split", splits.split_name(config.valid_size, config.seed)), "prepared")
    if labels is not None:
        test = prepared.where(F.col(IS_TEST))
        more = pseudo_labels.append_pseudo_labels(prepared.limit(0), test, labels, config.uncertainty_level)
        prepared = prepared.unionByName(more.withColumn("split", F.lit("train")))
    fit_rows = prepared.where(F.col("split") == "train")
    continuous, categorical = projections.model_columns(network=True)
    preprocessor = encoding.fit_preprocessor(fit_rows, continuous, categorical, unknown="count")
    coded = projections.log_target(preprocessor.transform(prepared), TARGET, "log_price")
    rows = projections.select_features(coded, [KEY, "split", "log_price"], continuous, categorical)
    sizes = prepared.sparkSession.createDataFrame(
        [(c, n + 1) for c, n in preprocessor.codes.sizes.items()], "column string, cardinality bigint"
    )
    scaled = config.embed_scale > 0 or config.embed_dims
    embeddings = encoding.embedding_widths(sizes, config.embed_scale, config.embed_dims) if scaled else sizes
    return NetworkInputs(rows, embeddings, preprocessor)


def photo_inputs(photos: DataFrame, split: str, order: str, value: str, zero: Column) -> DataFrame:
    """Padded photo sequences of one split's listings."""
    chosen = sequences.photo_fallback(photos, split)
    return sequences.pad_sequences(sequences.first_photos(chosen, order), value, zero)


def photo_pixel_inputs(images: DataFrame, split: str, config: RunConfig = RunConfig(), order: str = "name") -> DataFrame:
    """(key, sequence, mask): the first photos of one split's listings, at one size, as padded pixel arrays.

    `images` are decoded photos (key, split, `order`, height, width, n_channels, data). The photos are chosen from keys and names
    alone, and only chosen ones are resized. `target_size` above 0 cuts a square of that side, else photos are stretched
    to `im_size`; with `norm_image` pixels are normalised, and padding photos are zero either way.
    """
    names = images.select(KEY, "split", order)
    chosen = sequences.first_photos(sequences.photo_fallback(names, split), order)
    # While the choice is small the photos stay where they are.
    kept = images.join(joinable(as_table(chosen, "chosen-photos")), [KEY, "split", order])
    return _padded(pixels.resize_photos(kept, config.target_size, config.im_size, config.norm_image), config)


def _padded(resized: DataFrame, config: RunConfig) -> DataFrame:
    height, width = (config.target_size,) * 2 if config.target_size > 0 else config.im_size
    entry = "float" if config.norm_image else "smallint"
    zero = F.array_repeat(F.lit(0).cast(entry), height * width * 3)
    return sequences.pad_sequences(resized, "pixels", zero)


# Paths that one decoding job takes.
DECODED_AT_ONCE = 20_000


def photo_file_inputs(
    spark: SparkSession, root: str, split: str, config: RunConfig = RunConfig(), at_once: int = DECODED_AT_ONCE
) -> tuple[DataFrame, dict[str, int]]:
    """(`photo_pixel_inputs` of a photo tree, `n_photos` decoded and `n_undecoded` of them), each chosen file decoded once.

    The photos are chosen from the listing of the tree, for which no file is read. Only chosen ones are decoded, in batches of bounded
    number, and written resized. Where a chosen file turns out to be no image, it is taken off the listing and the choice is made
    again, until every chosen file has been decoded.
    """
    photo = [KEY, "split", "name"]
    listed = as_table(photos.read_photos(spark, root).select("path", *photo), "listed-photos")
    resized, tried = fresh_path(spark, "resized-photos"), []
    counts = {"n_photos": 0, "n_undecoded": 0}
    while True:
        chosen = as_table(sequences.first_photos(sequences.photo_fallback(listed, split), "name"), "chosen-photos")
        wanted = chosen
        for earlier in tried:
            wanted = wanted.join(earlier, "path", "left_anti")
        wanted = as_table(wanted.select("path"), "wanted-photos")
        paths = (row["path"] for row in wanted.toLocalIterator())
        while batch := list(islice(paths, at_once)):
            counted = Observation(f"decoded-{uuid.uuid4().hex}")
            images = photos.decode_files(spark, batch, counted).drop("path")
            pixels.resize_photos(images, config.target_size, config.im_size, config.norm_image).write.mode("append").parquet(resized)
            counts = {name: n + counted.get[name] for name, n in counts.items()}
        tried.append(wanted)
        done = spark.read.parquet(resized) if counts["n_photos"] else None
        if done is None:
            # A tree without photos gives no rows, of the same columns.
            done = pixels.resize_photos(photos.decode_photos(spark, root).drop("path"), config.target_size, config.im_size, config.norm_image)
        if wanted.isEmpty() or counts["n_undecoded"] == 0:
            return _padded(done.join(chosen.select(*photo, "position"), photo), config), counts
        broken = wanted.join(chosen, "path").join(done.select(*photo), photo, "left_anti").select("path")
        listed = as_table(listed.join(broken, "path", "left_anti"), "listed-photos")
