"""Runs with real settings over whole tables, by properties; and runs saved for another session."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import metrics
from estatespark.plans import saved_runs, training
from estatespark.verification.catalog import CHECKS
from estatespark.verification.models import CURVE
from estatespark.verification.views import view

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", ["gbt_default", "tree_run_default"])
def test_default_runs_score_every_row_once(spark, name):
    listings = view(spark, SF_DIR, "listing")
    scored = CHECKS[name].run(spark, SF_DIR).join(listings.select("listing_id", F.col("price").alias("actual")), "listing_id").persist()
    assert scored.count() == listings.count() == scored.select("listing_id").distinct().count()
    assert scored.where("prediction is null or prediction <= 0").count() == 0
    median = listings.where("not is_test").agg(F.median("price")).first()[0]
    fair = metrics.mape(listings.where("not is_test").withColumn("m", F.lit(median)), "price", "m").first()["mape"]
    for split in ("train", "valid"):
        assert metrics.mape(scored.where(F.col("split") == split), "actual", "prediction").first()["mape"] < 0.9 * fair


def test_the_curve_ends_with_patience(spark):
    rows = CHECKS["early_stop_curve"].run(spark, SF_DIR).orderBy("tree").collect()
    errors, best = [r.error for r in rows], int(np.argmin([r.error for r in rows]))
    assert [r.tree for r in rows] == list(range(1, len(rows) + 1)) and [r.kept for r in rows] == [i <= best for i in range(len(rows))]
    # The prices of these tables are close to noise, so the best tree may be the first one.
    assert len(rows) == CURVE.iterations or len(rows) - 1 - best >= CURVE.early_stopping_rounds


def test_a_search_over_ranges(spark):
    rows = CHECKS["random_search_range"].run(spark, SF_DIR).collect()
    assert {(r.run, r.metric) for r in rows} == {(f"trial_000{i}", m) for i in range(2) for m in ("MAPE_train", "MAPE_valid")}
    assert all(0 < r.value < 2 for r in rows)


SCORE = """
import json, sys
from estatespark.plans.saved_runs import load_run
from estatespark.session import build_session
from estatespark.sources.tables import read_table
spark = build_session("scoring", "local[2]", spark__sql__shuffle__partitions=2)
path, listings, images, out = sys.argv[1:]
scored = load_run(spark, path).transform(read_table(spark, listings), read_table(spark, images))
scored.write.parquet(out)
print(json.dumps(scored.columns))
"""


def test_a_saved_run_scores_in_another_session(spark, tmp_path):
    listings = view(spark, SF_DIR, "listing").persist()
    images = listings.where("listing_id % 3 <> 0").select("listing_id", F.array(F.col("size") / 100, F.lit(1.0), F.col("nb_rooms") * 2.0).alias("vector"))
    images = images.where("vector[0] is not null and vector[2] is not null")
    config = RunConfig(
        n_folds=2, max_depth=4, leaf_values="median", use_image_features=True, n_pca_features=2, quantile_transform="normal", n_quantiles=20, clip_rooms=(1, 8)
    )
    run = training.run_trees(listings, config, images)
    path, new, vectors, out = (str(tmp_path / name) for name in ("run", "new", "vectors", "out"))
    saved_runs.save_run(run, path)
    test = listings.where("is_test")
    test.drop("price", "is_test").withColumn("remark", F.lit("new")).write.parquet(new)
    images.write.parquet(vectors)
    done = subprocess.run([sys.executable, "-c", SCORE, path, new, vectors, out], capture_output=True, text=True, cwd=ROOT, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.splitlines()[-1]) == [*test.drop("price", "is_test").columns, "remark", "prediction"]
    own = {r.listing_id: r.prediction for r in run.scored.where("is_test").collect()}
    found = {r.listing_id: r.prediction for r in spark.read.parquet(out).collect()}
    assert set(found) == set(own) and len(own) > 100 and all(found[k] == pytest.approx(own[k], rel=1e-12) for k in own)


def test_listings_that_a_saved_run_has_not_seen(spark, tmp_path):
    listings = view(spark, SF_DIR, "listing")
    path = str(tmp_path / "run")
    saved_runs.save_run(training.run_trees(listings, RunConfig(n_folds=2, iterations=1)), path)
    model = saved_runs.load_run(spark, path)
    odd = listings.limit(3).withColumns({"city": F.lit("nowhere"), "postal_code": F.lit(99_999).cast("bigint"), "size": F.lit(None).cast("double")})
    assert model.transform(odd).where("prediction > 0").count() == 3 and model.transform(odd.limit(0)).count() == 0
    assert model.transform(odd).columns == [*odd.columns, "prediction"]
    with pytest.raises(Exception):
        saved_runs.load_run(spark, str(tmp_path / "nothing"))
