"""Boosting that goes on until the validation error no longer falls, and what it leaves on disk meanwhile."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from estatespark import session
from estatespark.config import RunConfig
from estatespark.operators import boosting
from estatespark.schema import LISTING
from estatespark.verification import models as checks
from estatespark.verification.catalog import CHECKS


@pytest.fixture
def grown(monkeypatch):
    numbers, own = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda current, number, *rest: (numbers.append(number), own(current, number, *rest))[1])
    return numbers


def test_gbt_default_boosts_until_patience_runs_out(spark, monkeypatch, grown):
    """The first tree explains these prices wholly, so that fitting ends with the block in which twenty more brought nothing."""
    kinds = ["maison", "appartement", "terrain"]
    rows = [(i, kinds[i % 3], "x", 1000 + i % 4, float(10 + i % 9), i % 10 == 0, None if i % 10 == 0 else 100.0 * (1 + i % 3)) for i in range(600)]
    given = spark.createDataFrame(rows, "listing_id bigint, property_type string, city string, postal_code bigint, size double, is_test boolean, price double")
    listings = given.withColumns({f.name: F.lit(None).cast(f.dataType) for f in LISTING.fields if f.name not in given.columns})
    monkeypatch.setattr(checks, "view", lambda spark, sf, name: listings)
    scored = {r["listing_id"]: r["prediction"] for r in CHECKS["gbt_default"].run(spark, "").collect()}
    assert grown == list(range(30))
    assert len(scored) == 600 and all(scored[i] == pytest.approx(100.0 * (1 + i % 3)) for i in scored)


def test_one_state_of_a_fit_lies_on_disk(spark, monkeypatch, grown):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    rows = [(Vectors.dense(v), float(v[0] + np.sin(v[1])), i % 4 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["features", "label", "held"]).persist()
    fit, held = (df.where(c).select("features", "label") for c in ("not held", "held"))
    config = RunConfig(iterations=7, learning_rate=0.3, max_depth=2, early_stopping_rounds=7)
    whole, errors = boosting.fit_boosted(fit, held, config, block_trees=10)
    grown.clear()
    with session.run_folder(spark) as folder:
        trees, found = boosting.fit_boosted(fit, held, config, block_trees=2)
        assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("residuals")]) == 1
    assert grown == list(range(7)) and found == pytest.approx(errors, abs=1e-9)
    assert [t.feature for t in trees.trees] == [t.feature for t in whole.trees]
