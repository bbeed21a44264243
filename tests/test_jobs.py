"""A run from CSV files to CSV files."""

import os
import threading
from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.plans import jobs
from estatespark.schema import FEATURES, LABELS, LISTING, PSEUDO_LABELS
from estatespark.session import BroadcastBudget, as_table, in_this_run, joinable, run_folder, shared_dir
from estatespark.sources import sinks, tables


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1200):
        size = float(rng.integers(20, 200))
        row = {f.name: None for f in LISTING.fields}
        row.update(
            listing_id=i, property_type=["maison", "appartement"][i % 2], city=f"c{i % 5}", postal_code=1000 + i % 9,
            size=size if i % 11 else None, nb_photos=float(i % 9), is_test=i % 4 == 0, price=size * 2000 * float(np.exp(rng.normal(0, 0.1))),
        )
        rows.append(tuple(row[f.name] for f in LISTING.fields))
    df = spark.createDataFrame(rows, LISTING)
    paths = {name: str(root / f"{name}.csv") for name in ("train", "test", "labels", "template", "pseudo", "images")}
    parts = {
        "train": df.where("not is_test").select(*FEATURES.fieldNames()),
        "test": df.where("is_test").select(*FEATURES.fieldNames()),
        "labels": df.where("not is_test").select(*LABELS.fieldNames()),
        "template": df.where("is_test").select("listing_id", F.lit(0.0).alias("price")),
        "pseudo": df.where("is_test").select("listing_id", "price", (F.col("listing_id") % 10 / 10).alias("uncertainty")),
    }
    for name, part in parts.items():
        part.write.option("header", True).csv(paths[name])
    images = df.where("listing_id % 6 <> 0").select(
        "listing_id", (F.col("listing_id") % 5).cast("float").alias("image_feature_0"), F.rand(1).cast("float").alias("image_feature_1")
    )
    paths["images"] = paths["images"].replace(".csv", ".parquet")
    images.write.parquet(paths["images"])
    return root, paths, df


def test_loading_joins_prices_by_key(spark, files):
    _, paths, df = files
    loaded = jobs.load_listings(spark, paths["train"], paths["test"], paths["labels"])
    assert loaded.count() == 1200 and loaded.where("is_test and price is not null").count() == 0
    same = loaded.where("not is_test").select(*LISTING.fieldNames())
    assert same.exceptAll(df.where("not is_test")).count() == 0
    sample = jobs.load_listings(spark, paths["train"], paths["test"], paths["labels"], RunConfig(debug=True))
    assert 0 < sample.count() < 60 and sample.where("not is_test and price is null").count() == 0


def test_tree_job_writes_every_template_row(spark, files):
    root, paths, df = files
    output = str(root / "out")
    config = RunConfig(
        iterations=20, learning_rate=0.3, max_depth=4, n_folds=2, use_image_features=True, pseudo_labels=paths["pseudo"],
        uncertainty_level=0.3, quantile_transform="uniform", clip_rooms=(1, 10), n_quantiles=20,
    )
    result = jobs.tree_job(
        spark, paths["train"], paths["test"], paths["labels"], paths["template"], output, config, (paths["images"],), "first"
    )
    submission = tables.read_table(spark, f"{output}/submission.csv", LABELS)
    truth = df.where("is_test").select("listing_id", F.col("price").alias("actual"))
    joined = submission.join(truth, "listing_id")
    assert joined.count() == 300 and joined.where("price is null").count() == 0
    error = joined.agg(F.avg(F.abs(F.col("price") / F.col("actual") - 1))).first()[0]
    assert error < 0.35
    assert spark.read.parquet(f"{output}/metrics").count() == 2
    assert "image_feature_0" in {r["feature"] for r in result.importances.collect()}


def test_pseudo_label_schema(spark, files):
    _, paths, _ = files
    assert tables.read_keyed(spark, paths["pseudo"], PSEUDO_LABELS, "listing_id").count() == 300


def test_written_nan_is_missing(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("listing_id,price\n1,NaN\n2,3.5\n3,\n")
    rows = tables.read_table(spark, str(tmp_path / "labels.csv"), LABELS).orderBy("listing_id").collect()
    assert [r["price"] for r in rows] == [None, 3.5, None]


def test_nan_in_parquet_is_missing(spark, tmp_path):
    path = str(tmp_path / "labels.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 3.5), (3, None)], LABELS).write.parquet(path)
    for schema in (LABELS, None):
        rows = tables.read_table(spark, path, schema).orderBy("listing_id").collect()
        assert [r["price"] for r in rows] == [None, 3.5, None]


def test_photo_features_from_csv(spark, files, tmp_path):
    _, paths, _ = files
    wide = spark.read.parquet(paths["images"])
    path = str(tmp_path / "images.csv")
    # Columns in an order of their own.
    wide.select("image_feature_1", "listing_id", "image_feature_0").write.option("header", True).csv(path)
    packed = {r["listing_id"]: r["vector"] for r in jobs.load_image_features(spark, path).collect()}
    assert packed == {r["listing_id"]: r["vector"] for r in jobs.load_image_features(spark, paths["images"]).collect()}
    odd = str(tmp_path / "odd.csv")
    wide.withColumnRenamed("image_feature_1", "feature").write.option("header", True).csv(odd)
    with pytest.raises(ValueError):
        jobs.load_image_features(spark, odd)


def test_a_run_leaves_nothing_behind(spark, files, tmp_path):
    shared = shared_dir(spark)
    before = set(os.listdir(shared.removeprefix("file:")))
    with pytest.raises(ZeroDivisionError):
        with run_folder(spark) as folder:
            table = as_table(spark.range(5), "numbers")
            assert table.count() == 5 and folder in table.inputFiles()[0]
            1 / 0
    with run_folder(spark):
        as_table(spark.range(5), "numbers")
    assert set(os.listdir(shared.removeprefix("file:"))) == before


def test_runs_that_overlap_keep_their_tables(spark):
    shared = shared_dir(spark)
    first_open, second_open, first_ended = threading.Event(), threading.Event(), threading.Event()
    found = {}

    def first():
        with run_folder(spark) as folder:
            first_open.set()
            assert second_open.wait(60)
            found["first"] = folder, as_table(spark.range(3), "numbers").inputFiles()[0]
        first_ended.set()

    def second():
        assert first_open.wait(60)
        with run_folder(spark) as folder:
            table = as_table(spark.range(4), "numbers")
            second_open.set()
            assert first_ended.wait(60)
            found["second"], found["rows"] = (folder, table.inputFiles()[0]), table.count()

    threads = [threading.Thread(target=job) for job in (first, second)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert all(folder in path and os.path.dirname(folder) == shared for folder, path in (found["first"], found["second"]))
    assert found["rows"] == 4 and found["first"][0] != found["second"][0]


def test_threads_of_a_run_write_to_its_folder(spark):
    with run_folder(spark) as folder:
        with ThreadPool(2) as pool:
            paths = pool.map(in_this_run(lambda n: as_table(spark.range(n), "numbers").inputFiles()[0]), [1, 2, 3])
        with run_folder(spark) as inner:
            assert inner in as_table(spark.range(1), "numbers").inputFiles()[0]
        assert all(folder in path for path in paths) and folder in as_table(spark.range(1), "numbers").inputFiles()[0]


def test_writes_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for run, value in (("0001", 1.0), ("b", 2.0), ("0001", 3.0)):
        sinks.append_metrics(spark.createDataFrame([(run, "MAPE_valid", value), (run, "MAPE_train", value)], "run string, metric string, value double"), path)
    rows = sinks.read_metrics(spark, path).collect()
    assert sorted((r.run, r.value) for r in rows) == [("0001", 3.0)] * 2 + [("b", 2.0)] * 2
    features, wide = str(tmp_path / "features"), "listing_id bigint, image_feature_0 double, split string"
    for split, value in (("train", 1.0), ("test", 2.0), ("train", 5.0)):
        assert sinks.write_features(spark.createDataFrame([(1, value, split)], wide), features) == 1
    assert {(r.split, r.image_feature_0) for r in spark.read.parquet(features).collect()} == {("train", 5.0), ("test", 2.0)}


def test_a_job_run_again_and_its_model(spark, files, tmp_path):
    _, paths, _ = files
    config = RunConfig(iterations=3, learning_rate=0.3, max_depth=3, n_folds=2, leaf_values="median")
    output = str(tmp_path / "out")
    found = []
    for _ in range(2):
        jobs.tree_job(spark, paths["train"], paths["test"], paths["labels"], paths["template"], output, config, run="r", save=True)
        found.append({r.listing_id: r.price for r in tables.read_table(spark, f"{output}/submission.csv", LABELS).collect()})
        assert sinks.read_metrics(spark, f"{output}/metrics").count() == 2 and spark.read.parquet(f"{output}/scored").count() == 1200
    assert found[0] == pytest.approx(found[1], rel=1e-12)
    scored = jobs.score_job(spark, f"{output}/model", paths["test"], paths["template"], str(tmp_path / "scored"))
    assert {r.listing_id: r.price for r in scored.collect()} == pytest.approx(found[1], rel=1e-9)


def test_broadcasts_share_a_budget(spark):
    table = as_table(spark.range(100), "numbers")
    budget = BroadcastBudget(2000)
    hinted = ["broadcast" in joinable(table, size, budget)._jdf.queryExecution().logical().toString().lower() for size in (1500, 600, 500, 1)]
    assert hinted == [True, False, True, False]


def test_template_rows_without_prediction_stay(spark):
    template = spark.createDataFrame([(1, 0.0), (2, 0.0)], LABELS)
    predictions = spark.createDataFrame([(2, 7.0)], "listing_id bigint, prediction double")
    filled = sinks.fill_template(template, predictions, "prediction")
    assert sorted((r["listing_id"], r["price"]) for r in filled.collect()) == [(1, None), (2, 7.0)]
