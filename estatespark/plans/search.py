"""Random search over the settings of whole runs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators.search import apply_settings
from estatespark.plans import training
from estatespark.session import as_table, fresh_path, in_this_run

# Settings that only the fit reads: trials that differ in no others share their prepared rows.
FIT_SETTINGS = (
    "n_folds", "uncertainty_level", "iterations", "learning_rate", "max_depth", "one_hot_max_size", "random_seed", "early_stopping",
    "early_stopping_rounds", "border_count", "subsample", "loss", "leaf_values",
)


TRIALS = "run string, settings string, metric string, value double"


def search_runs(
    listings: DataFrame,
    settings: Sequence[Mapping],
    config: RunConfig = RunConfig(),
    image_features: DataFrame | None = None,
    labels: DataFrame | None = None,
    folder: str | None = None,
    parallelism: int = 1,
) -> DataFrame:
    """(run, metric, value) of one run per setting: MAPE_train, and MAPE_valid to choose by, over the hash split of the run.

    Names that a run does not take are refused before anything runs. Trials are written one by one; with a `folder`, a search that
    broke goes on behind the trials that lie there with the same settings. `parallelism` trials run side by side, each in a
    scheduler pool of its own, so that under fair scheduling none waits for another's tasks.
    """
    if not settings:
        raise ValueError("a search needs at least one setting")
    spark = listings.sparkSession
    configs = {f"trial_{i:04d}": apply_settings(config, chosen) for i, chosen in enumerate(settings)}
    described = {run: json.dumps(dict(settings[i]), sort_keys=True, default=str) for i, run in enumerate(configs)}
    path = folder or fresh_path(spark, "trials")
    done = _finished(spark, path)
    open_runs = [run for run in configs if done.get(run) != described[run]]
    keys = {run: tuple((k, str(v)) for k, v in sorted(vars(configs[run]).items()) if k not in FIT_SETTINGS) for run in open_runs}
    prepared: dict[tuple, tuple] = {}
    for run, key in keys.items():
        if key not in prepared:
            table, continuous, categorical = training.model_table(listings, configs[run], image_features)
            prepared[key] = (as_table(table, "prepared"), continuous, categorical)

    def trial(run: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", run)
        found = training.fit_and_score(*prepared[keys[run]], configs[run], labels, run).metrics
        rows = found.select("run", F.lit(described[run]).alias("settings"), "metric", "value").coalesce(1)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)

    if open_runs:
        with ThreadPool(max(1, min(parallelism, len(open_runs)))) as pool:
            pool.map(inheritable_thread_target(spark)(in_this_run(trial)), open_runs)
    # A folder may hold trials of a longer search.
    return spark.read.schema(TRIALS).parquet(path).where(F.col("run").isin(list(configs))).select("run", "metric", "value")


def _finished(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of the trials that were written before: a row or two for each."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return {}
    rows = spark.read.schema(TRIALS).parquet(path).where(F.col("metric") == "MAPE_valid").select("run", "settings").collect()
    return {row["run"]: row["settings"] for row in rows}
