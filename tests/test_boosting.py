"""Trees grown in blocks, against the library's own boosting and plain medians."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from estatespark import session
from estatespark.config import RunConfig, config_from_mapping
from estatespark.functions import quantiles
from estatespark.functions.quantiles import medians_by_group
from estatespark.operators import boosting
from estatespark.operators.boosting import BoostedTrees, Tree, fit_boosted


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 4))
    # Errors with a long tail on one side, where means and medians differ.
    y = 12 + x[:, 0] + np.sin(2 * x[:, 1]) + rng.exponential(0.4, size=1200)
    rows = [(Vectors.dense(v), float(t), i % 4 == 0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["features", "label", "held"]).repartition(3).persist()
    return df.where("not held").select("features", "label"), df.where("held").select("features", "label"), x, y


def test_means_are_the_librarys_own_boosting(data):
    fit, held, _, _ = data
    config = RunConfig(iterations=4, learning_rate=0.3, max_depth=3)
    library = GBTRegressor(lossType="absolute", maxIter=4, stepSize=0.3, maxDepth=3, maxBins=config.border_count, seed=0).fit(fit)
    trees, errors = fit_boosted(fit, None, config)
    assert errors == [] and trees.getNumTrees == 4 and trees.numFeatures == 4 and sum(trees.importances()) == pytest.approx(1.0)
    both = trees.transform(library.transform(held)).select("prediction", "log_prediction").collect()
    assert all(r.prediction == pytest.approx(r.log_prediction, abs=1e-9) for r in both)
    assert trees.evaluate_each(held) == pytest.approx(list(library.evaluateEachIteration(held, "absolute")), abs=1e-9)


def leaf_of(tree, row):
    at = 0
    while tree.feature[at] >= 0:
        at = tree.left[at] if row[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
    return at


@pytest.mark.parametrize("loss", ["absolute", "percentage"])
def test_leaves_hold_medians_of_their_residuals(data, loss):
    fit, _, x, y = data
    config = RunConfig(iterations=3, learning_rate=0.5, max_depth=3, loss=loss, leaf_values="median")
    trees, _ = fit_boosted(fit, None, config)
    used = np.arange(1200) % 4 != 0
    rows, residual = x[used], y[used].copy()
    weight = np.ones(len(rows)) if loss == "absolute" else 1 / np.maximum(np.abs(y[used]), 1)
    for tree, scale in zip(trees.trees, trees.scales):
        leaves = np.array([leaf_of(tree, row) for row in rows])
        for leaf in set(leaves.tolist()):
            own, mass = residual[leaves == leaf], weight[leaves == leaf]
            if loss == "absolute":
                assert tree.value[leaf] == pytest.approx(np.median(own), abs=1e-9)
            else:
                order = np.argsort(own)
                below = np.cumsum(mass[order]) - mass[order]
                assert tree.value[leaf] == pytest.approx(own[order][np.flatnonzero(below <= mass.sum() / 2)[-1]], abs=1e-9)
        residual -= scale * np.array(tree.value)[leaves]
    assert trees.scales == (1.0, 0.5, 0.5)


def test_medians_lower_the_held_out_percentage_error(data):
    fit, held, _, _ = data

    def error(**settings):
        trees, _ = fit_boosted(fit, None, RunConfig(iterations=8, learning_rate=0.3, max_depth=4, **settings))
        return trees.transform(held).agg(F.avg(F.abs(F.exp("log_prediction") - F.exp("label")) / F.exp("label"))).first()[0]

    assert error(loss="percentage", leaf_values="median") < 0.95 * error()


def test_fitting_ends_with_patience(data):
    fit, held, _, _ = data
    config = RunConfig(iterations=40, learning_rate=0.9, max_depth=3, leaf_values="median")
    every, curve = fit_boosted(fit, held, RunConfig(**{**vars(config), "iterations": 12}))
    some, errors = fit_boosted(fit, held, RunConfig(**{**vars(config), "early_stopping_rounds": 2}), block_trees=3)
    assert len(curve) == 12 and len(errors) < 40 and len(errors) % 3 == 0
    assert errors[: len(curve)] == pytest.approx(curve[: len(errors)], abs=1e-9)
    assert some.getNumTrees == boosting.best_prefix(errors, 2) and every.getNumTrees == int(np.argmin(curve)) + 1
    assert some.evaluate_each(held) == pytest.approx(errors[: some.getNumTrees], abs=1e-9)


def test_a_broken_fit_goes_on_behind_its_last_block(data, tmp_path, monkeypatch):
    fit, held, _, _ = data
    config = RunConfig(iterations=6, learning_rate=0.3, max_depth=2, leaf_values="median")
    whole, curve = fit_boosted(fit, held, config, block_trees=2)
    folder, grown, own = str(tmp_path / "state"), [], boosting.grow

    def grow(current, number, *rest):
        if len(grown) == 3:
            raise RuntimeError("lost")
        grown.append(number)
        return own(current, number, *rest)

    monkeypatch.setattr(boosting, "grow", grow)
    with pytest.raises(RuntimeError):
        fit_boosted(fit, held, config, folder, block_trees=2)
    assert grown == [0, 1, 2]
    grown.clear()
    monkeypatch.setattr(boosting, "grow", lambda current, number, *rest: (grown.append(number), own(current, number, *rest))[1])
    again, errors = fit_boosted(fit, held, config, folder, block_trees=2)
    assert grown == [2, 3, 4, 5]
    assert errors == pytest.approx(curve, abs=1e-12) and [t.feature for t in again.trees] == [t.feature for t in whole.trees]
    assert [t.value for t in again.trees] == [pytest.approx(t.value) for t in whole.trees]
    grown.clear()
    assert fit_boosted(fit, held, config, folder, block_trees=2)[0].getNumTrees == again.getNumTrees and grown == []


@pytest.mark.parametrize("direct_rows", [0, 10**6])
def test_weighted_medians_of_any_size(spark, direct_rows, monkeypatch):
    monkeypatch.setattr(quantiles, "CELL_VALUES", 40)
    rng = np.random.default_rng(2)
    rows = [("hot", float(v), float(w)) for v, w in zip(np.exp(rng.normal(0, 3, 3000)) * rng.choice([-1, 1], 3000), rng.random(3000) + 0.01)]
    rows += [("near", 1.0 + i * 1e-12, 1.0 + i % 3) for i in range(600)] + [("ties", float(i % 5), 0.5) for i in range(500)] + [("one", -2.0, 3.0)]
    df = spark.createDataFrame(rows + [("hot", None, 1.0), ("zero", 4.0, 0.0)], "k string, v double, w double").repartition(4)
    found = {r.k: r.median for r in medians_by_group(df, "k", "v", "w", len(rows), direct_rows).collect()}
    assert set(found) == {"hot", "near", "ties", "one"}
    for key, median in found.items():
        own = sorted((v, w) for k, v, w in rows if k == key)
        below = np.cumsum([w for _, w in own]) - [w for _, w in own]
        half = sum(w for _, w in own) / 2
        distinct = {}
        for (v, _), b in zip(own, below):
            distinct.setdefault(v, b)
        assert median == max(v for v, b in distinct.items() if b <= half + 1e-9)
    plain = {r.k: r.median for r in medians_by_group(df, "k", "v", None, len(rows), direct_rows).collect()}
    assert all(plain[k] == pytest.approx(np.median([v for g, v, _ in rows if g == k]), abs=1e-12) for k in found)


def test_a_tree_of_one_leaf(spark):
    flat = spark.createDataFrame([(Vectors.dense([1.0]), 5.0)] * 4, ["features", "label"])
    trees, _ = fit_boosted(flat, None, RunConfig(iterations=1, leaf_values="median"))
    assert trees.trees == (Tree((-1,), (0.0,), (-1,), (-1,), (5.0,)),) and trees.importances() == [0.0]
    assert [r.log_prediction for r in trees.transform(flat).collect()] == [5.0] * 4
    assert BoostedTrees((), (), ()).transform(flat.limit(0)).count() == 0


def test_loss_functions_of_run_files():
    assert config_from_mapping({"model_params": {"loss_function": "MAPE"}}).loss == "percentage"
    assert config_from_mapping({"loss_function": "MAE"}).leaf_values == "median" and config_from_mapping({}).leaf_values == "mean"
    with pytest.raises(ValueError):
        config_from_mapping({"loss_function": "RMSE"})
    with pytest.raises(ValueError):
        RunConfig(leaf_values="mode")


def test_no_tree_is_walked_again_where_leaves_hold_medians(data, monkeypatch, spark):
    fit, held, _, _ = data
    seen, own = [], boosting.grow

    def grow(current, number, *rest):
        seen.append(current._jdf.queryExecution().optimizedPlan().toString().count("UDF("))
        return own(current, number, *rest)

    monkeypatch.setattr(boosting, "grow", grow)
    with session.run_folder(spark) as folder:
        trees, errors = fit_boosted(fit, held, RunConfig(iterations=4, max_depth=2, learning_rate=0.5, leaf_values="median"))
        kept = [name for name in os.listdir(folder.removeprefix("file:")) if name.startswith("leaves-")]
        assert trees.evaluate_each(held) == pytest.approx(errors[: trees.getNumTrees], abs=1e-9)
    assert seen == [0] * 4 and len(errors) == 4 and len(kept) == 1
