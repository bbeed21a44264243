"""Jobs from files to files: load the listing tables, run the trees, write submission, metrics and importances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import pixels, splits, vectors
from estatespark.plans import image_features, saved_runs, training
from estatespark.schema import FEATURES, IS_TEST, KEY, LABELS, PSEUDO_LABELS, SUBMISSION
from estatespark.session import remove_path, run_folder
from estatespark.sources import sinks, tables


def load_listings(spark: SparkSession, train: str, test: str, labels: str, config: RunConfig = RunConfig()) -> DataFrame:
    """Train and test listings as one table, with prices where known. `debug` keeps a sample of both."""
    rows = splits.union_splits(tables.read_table(spark, train, FEATURES), tables.read_table(spark, test, FEATURES))
    prices = tables.read_keyed(spark, labels, LABELS, KEY)
    if config.debug:
        rows, prices = splits.aligned_sample(rows, prices, seed=config.seed)
    return splits.join_labels(rows, prices)


def load_image_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Wide feature tables of the splits, packed as (key, vector)."""
    wide = [tables.read_image_features(spark, path) for path in paths]
    stacked = wide[0]
    for other in wide[1:]:
        stacked = vectors.union_vectors(stacked, other)
    columns = sorted(
        (c for c in stacked.columns if c.startswith("image_feature_")), key=lambda c: int(c.rsplit("_", 1)[1])
    )
    return vectors.pack(stacked.select(KEY, *columns), columns, "vector")


def tree_job(
    spark: SparkSession,
    train: str,
    test: str,
    labels: str,
    template: str,
    output: str,
    config: RunConfig = RunConfig(),
    image_feature_paths: tuple[str, ...] = (),
    run: str = "run",
    save: bool = False,
) -> training.TreeRun:
    """Writes `submission.csv`, `metrics` and `importances` under `output`; what was written on the way is gone at the end.

    Returns the tables as they lie under `output`. With `save` the run lies there as well, in `model`, for `saved_runs.load_run`. The
    same job run again replaces its own results; metrics of other runs stay.
    """
    listings = load_listings(spark, train, test, labels, config)
    images = load_image_features(spark, *image_feature_paths) if config.use_image_features and image_feature_paths else None
    source = config.pseudo_label_source
    pseudo = tables.read_keyed(spark, source, PSEUDO_LABELS, KEY) if source else None
    with run_folder(spark):
        result = training.run_trees(listings, config, images, pseudo, run)
        rows = tables.read_table(spark, template, SUBMISSION)
        result.scored.select(KEY, IS_TEST, "split", "prediction").write.mode("overwrite").parquet(f"{output}/scored")
        scored = spark.read.parquet(f"{output}/scored")
        predicted = scored.where(F.col(IS_TEST))
        sinks.write_submission(sinks.fill_template(rows, predicted, "prediction"), f"{output}/submission.csv")
        sinks.append_metrics(result.metrics, f"{output}/metrics")
        result.importances.write.mode("overwrite").parquet(f"{output}/importances")
        if save:
            # A saved run is whole or not there, and a second attempt starts anew.
            remove_path(spark, f"{output}/model")
            saved_runs.save_run(result, f"{output}/model")
    own = sinks.read_metrics(spark, f"{output}/metrics").where(F.col("run") == run)
    return training.TreeRun(None, scored, own, spark.read.parquet(f"{output}/importances"))


def score_job(spark: SparkSession, model: str, listings: str, template: str, output: str, image_feature_paths: tuple[str, ...] = ()) -> DataFrame:
    """New listings scored by a saved run: writes `submission.csv` under `output` and returns it."""
    new = tables.read_table(spark, listings, FEATURES)
    images = load_image_features(spark, *image_feature_paths) if image_feature_paths else None
    scored = saved_runs.load_run(spark, model).transform(new, images)
    filled = sinks.fill_template(tables.read_table(spark, template, SUBMISSION), scored, "prediction")
    sinks.write_submission(filled, f"{output}/submission.csv")
    return tables.read_table(spark, f"{output}/submission.csv", filled.schema)


def image_feature_job(
    spark: SparkSession,
    photos: str,
    output: str,
    loader: Callable[[], Callable[[np.ndarray], np.ndarray]] = pixels.colour_summary,
    run: str = "run",
) -> dict[str, int]:
    """Photo tree to wide feature tables per split; the numbers of features, photos and undecoded photos go to `metrics`."""
    with run_folder(spark):
        counts = image_features.extract_features(spark, photos, f"{output}/image_features", loader)
    rows = [(run, name, float(count)) for name, count in counts.items()]
    sinks.append_metrics(spark.createDataFrame(rows, "run string, metric string, value double"), f"{output}/metrics")
    return counts
