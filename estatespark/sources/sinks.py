"""Writers for predictions, feature tables, metrics and resized photos.

A job that is run again replaces what it wrote before: tables are partitioned by what a job owns, a run or a split, and only the
partitions that are written again are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.operators.metrics import feature_count
from estatespark.schema import KEY, TARGET


def fill_template(template: DataFrame, predictions: DataFrame, predicted: str = TARGET, key: str = KEY) -> DataFrame:
    """The template's rows with the predicted price, matched by key; rows without a prediction keep NULL."""
    price = predictions.select(key, F.col(predicted).alias(TARGET))
    return template.drop(TARGET).join(price, key, "left").select(key, TARGET)


def write_submission(submission: DataFrame, path: str) -> None:
    """CSV with header. Large results stay a folder of part files."""
    submission.write.mode("overwrite").option("header", True).csv(path)


def write_features(features: DataFrame, path: str, split: str = "split", key: str = KEY) -> int:
    """Feature table in one folder per split, replaced split by split; returns the number of features."""
    _replaced(features, path, split)
    return feature_count(features.drop(split), key)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """(run, metric, value) rows, beside those of other runs; a run's earlier rows are replaced."""
    _replaced(metrics.select("run", "metric", "value").coalesce(1), path, "run")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What `append_metrics` has written, with runs as texts whatever they look like."""
    return spark.read.schema("run string, metric string, value double").parquet(path)


def _replaced(rows: DataFrame, path: str, owner: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def write_resized_photos(resized: DataFrame, path: str) -> None:
    """(split, key, name, height, width, pixels) rows, one folder per split as in the photo tree."""
    _replaced(resized, path, "split")
