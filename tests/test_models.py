"""Vectors, components and model jobs on generated rows with a known signal."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import metrics, models, search, splits, vectors
from estatespark.plans import training
from estatespark.plans.network_inputs import network_inputs
from estatespark.plans.search import search_runs
from estatespark.schema import CATEGORICAL, CONTINUOUS, LISTING


def test_mean_wide_and_packed_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0]), (2, None)], "listing_id bigint, v array<float>")
    means = {r["listing_id"]: r["v"] for r in vectors.vector_mean(df, "listing_id", "v").collect()}
    assert means == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    wide = vectors.widen(df, "v", 2)
    assert wide.columns == ["listing_id", "image_feature_0", "image_feature_1"]
    packed = vectors.pack(wide, ["image_feature_0", "image_feature_1"], "v")
    assert sorted(str(r["v"]) for r in packed.collect()) == sorted(str(r["v"]) for r in df.collect())


def test_components_match_a_decomposition(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 10
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(1000, None)]
    df = spark.createDataFrame(rows, "listing_id bigint, v array<double>")
    fitted = vectors.fit_components(df, "v", 3)
    centred = data - data.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    np.testing.assert_allclose(fitted.loadings(), axes, atol=1e-8)
    found = {r["listing_id"]: r["pca"] for r in fitted.transform(df, "v").collect()}
    assert found[1000] is None
    np.testing.assert_allclose([found[i] for i in range(300)], centred @ axes, atol=1e-7)


@pytest.fixture(scope="module")
def market(spark):
    """Prices that follow size, city and property type, with noise; a fifth of the rows are test rows."""
    rng = np.random.default_rng(4)
    cities = [f"city_{i}" for i in range(12)]
    rows = []
    for i in range(3000):
        size, city, kind = float(rng.integers(20, 200)), int(rng.integers(0, 12)), ["maison", "appartement"][i % 2]
        price = size * (1000 + 300 * city) * (1.3 if kind == "maison" else 1.0) * float(np.exp(rng.normal(0, 0.05)))
        row = {f.name: None for f in LISTING.fields}
        row.update(
            listing_id=i, property_type=kind, city=cities[city], postal_code=1000 + 1000 * city + i % 8, size=size,
            land_size=size * 2, nb_rooms=float(1 + size // 25), nb_photos=float(i % 9), is_test=i % 5 == 0,
            price=None if i % 5 == 0 else price,
        )
        rows.append(tuple(row[f.name] for f in LISTING.fields))
    return spark.createDataFrame(rows, LISTING).repartition(4).persist()


CONFIG = RunConfig(iterations=15, learning_rate=0.4, max_depth=5, n_folds=2)


@pytest.fixture(scope="module")
def run(market):
    return training.run_trees(market, CONFIG)


def test_trees_beat_the_median(market, run):
    errors = {r["metric"]: r["value"] for r in run.metrics.collect()}
    assert set(errors) == {"MAPE_train", "MAPE_valid"}
    known = market.where("not is_test")
    median = known.agg(F.median("price")).first()[0]
    baseline = metrics.mape(known.withColumn("m", F.lit(median)), "price", "m").first()["mape"]
    assert errors["MAPE_valid"] < 0.4 * baseline


def test_importances_name_the_signal(run):
    rows = run.importances.collect()
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert rows[0]["feature"] in ("size", "size_clean", "nb_rooms", "land_size")


def test_scores_cover_every_row_once(market, run):
    scored = run.scored.select("listing_id", "split", "prediction")
    assert scored.count() == market.count() == scored.select("listing_id").distinct().count()
    assert scored.where("prediction is null or prediction <= 0").count() == 0
    assert {r["split"] for r in scored.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_unseen_categories_and_missing_numbers_are_scored(market, run):
    fit = market.where("not is_test")
    from estatespark.operators.projections import prepare

    model = models.fit_price_model(prepare(fit), CONTINUOUS, RunConfig(iterations=2))
    new = prepare(fit.limit(5).withColumns({"city": F.lit("nowhere"), "property_type": F.lit("ship"), "size": F.lit(None).cast("double")}))
    assert model.transform(new).where("prediction > 0").count() == 5
    assert len(model.encoder.names) == model.trees.numFeatures


@pytest.mark.parametrize("rate", [0.01, 0.04, 0.4, 1.0])
def test_stopping_keeps_the_best_prefix(spark, rate):
    """The learner's own validation would stop at the first small gain, or go on past the best tree."""
    rng = np.random.default_rng(0)
    data = rng.normal(size=(1500, 3))
    label = data[:, 0] * 2 + np.sin(3 * data[:, 1]) + rng.normal(size=1500) * 0.3
    rows = [(Vectors.dense(x), float(y), i % 4 == 0) for i, (x, y) in enumerate(zip(data, label))]
    df = spark.createDataFrame(rows, ["features", "label", "held"]).persist()
    fit, held = df.where("not held"), df.where("held")
    config = RunConfig(iterations=14, learning_rate=rate, max_depth=3)
    learner = GBTRegressor(lossType="absolute", maxIter=14, stepSize=rate, maxDepth=3, maxBins=config.border_count, seed=0)
    errors = list(learner.fit(fit).evaluateEachIteration(held, "absolute"))
    kept = models.fit_trees(fit, held, config)
    assert kept.getNumTrees == int(np.argmin(errors)) + 1
    error = kept.transform(held).agg(F.avg(F.abs(F.col("label") - F.col("log_prediction")))).first()[0]
    assert error == pytest.approx(min(errors), abs=1e-9)
    assert models.fit_trees(fit, None, config).getNumTrees == 14


def test_patience():
    errors = [5.0, 4.0, 4.5, 4.6, 3.0, 3.0, 3.1, 3.2, 1.0]
    assert models.best_prefix(errors) == 9
    assert models.best_prefix(errors, 2) == 2 and models.best_prefix(errors, 3) == 5 and models.best_prefix(errors, 4) == 9
    assert models.best_prefix([2.0, 2.0]) == 1


@pytest.mark.parametrize("categories", [8, 9, 63, 64, 65, 10_000])
def test_one_rule_for_any_number_of_categories(spark, categories):
    """Slots up to the run's limit, smoothed means above it, whatever the number."""
    df = spark.range(20_000).select(
        F.col("id").alias("listing_id"), (F.col("id") % categories).cast("string").alias("c"), (F.col("id") % categories % 5).cast("double").alias("label")
    )
    encoder = models.fit_encoder(df, [], ["c"], one_hot_max_size=8)
    rows = encoder.attach(df).select("label", "c", vector_to_array(encoder.features(0)).alias("v")).limit(200).collect()
    if categories <= 8:
        assert len(encoder.names) == categories + 1 and all(sum(r.v) == 1.0 for r in rows)
    else:
        n, mean = 20_000 / categories, df.agg(F.avg("label")).first()[0]
        assert encoder.names == ("c",)
        assert all(abs(r.v[0] - (r.label * n + 10 * mean) / (n + 10)) < 0.05 for r in rows)


def test_no_row_sees_its_own_label(spark):
    """Each category has one row: without its own part only the overall mean is left."""
    df = spark.range(400).select(F.col("id").alias("listing_id"), F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("label"))
    encoder = models.fit_encoder(df, [], ["c"], n_folds=3, by_fold=True)
    part = models.part_of(3, 0)
    for member in range(3):
        rows = encoder.attach(df).select("label", splits.fold(3, 0).alias("fold"), part.alias("part"), vector_to_array(encoder.features(member, part)).alias("v")).collect()
        for r in rows:
            seen = [o.label for o in rows if o.part != r.part and o.fold != member]
            assert r.v[0] == pytest.approx(np.mean(seen))
    assert encoder.attach(df.withColumn("c", F.lit(None).cast("string"))).select(encoder.features(0)).distinct().count() == 1


def test_pseudo_labels_add_rows(market):
    config = RunConfig(iterations=3, learning_rate=0.5, max_depth=3, n_folds=2, uncertainty_level=10.0)
    result = training.pseudo_label_rounds(market, config)
    assert {r["run"] for r in result.metrics.collect()} == {"round_1"}


def test_image_features_join_the_run(spark, market):
    images = market.where("listing_id % 3 <> 0").select(
        "listing_id", F.array(F.col("size") / 100, F.lit(1.0), F.col("nb_photos")).alias("vector")
    )
    config = RunConfig(use_image_features=True, n_pca_features=2, quantile_transform="normal", n_quantiles=20)
    table, continuous, _ = training.model_table(market, config, images)
    assert continuous[14:16] == ["pca_feature_0", "pca_feature_1"]
    assert table.where("pca_feature_0 is null").count() == market.where("listing_id % 3 = 0").count()
    missing_first = spark.createDataFrame([(1, None)], "listing_id bigint, vector array<double>").union(images.where("listing_id <> 1"))
    _, names, _ = training.model_table(market, RunConfig(use_image_features=True, columns_to_add=()), missing_first)
    assert names[14:] == ["image_feature_0", "image_feature_1", "image_feature_2"]
    with pytest.raises(ValueError):
        training.model_table(market, RunConfig(features=("no_such_column",)))


def test_network_inputs_hold_codes_and_sizes(market):
    widths = dict.fromkeys(CATEGORICAL, 2)
    made = network_inputs(market, RunConfig(embed_dims=widths, quantile_transform="uniform", n_quantiles=30))
    sizes = {r["column"]: r["cardinality"] for r in made.embeddings.collect()}
    assert set(sizes) == set(CATEGORICAL) and sizes["city"] == 13
    top = made.rows.agg(*[F.max(c).alias(c) for c in CATEGORICAL]).first()
    assert all(top[c] < sizes[c] for c in CATEGORICAL)
    assert made.rows.where("split = 'test' and log_price is not null").count() == 0
    assert network_inputs(market, RunConfig(debug=True)).rows.count() < 100


def test_random_search(spark, market):
    space = {
        "a": {"value": 3},
        "b": {"values": [1, 2]},
        "c": {"min": 120, "max": 60, "distribution": "int_uniform"},
        "d": {"min": 0.06, "max": 0.02, "distribution": "log_uniform_values"},
        "e": {"min": 0.9, "max": 1.4, "distribution": "uniform"},
    }
    drawn = search.sample_settings(space, 50)
    assert drawn == search.sample_settings(space, 50) != search.sample_settings(space, 50, seed=1)
    assert all(s["a"] == 3 and s["b"] in (1, 2) and 60 <= s["c"] <= 120 and 0.02 <= s["d"] <= 0.06 and 0.9 <= s["e"] <= 1.4 for s in drawn)
    with pytest.raises(ValueError):
        search.sample_settings({"x": {"min": 1, "max": 2, "distribution": "odd"}}, 1)
    with pytest.raises(ValueError):
        search.apply_settings(RunConfig(), {"l2_leaf_reg": 1.0})
    assert search.apply_settings(RunConfig(), {"max_depth": 8}).max_depth == 8
    config = RunConfig(n_folds=2, learning_rate=0.5, features=("size", "city"), columns_to_add=())
    weak, strong = {"max_depth": 1, "iterations": 1}, {"max_depth": 5, "iterations": 4, "border_count": 10, "one_hot_max_size": 20, "subsample": 0.9}
    trials = search_runs(market, [weak, strong], config)
    assert {(r["run"], r["metric"]) for r in trials.collect()} == {(t, m) for t in ("trial_0000", "trial_0001") for m in ("MAPE_train", "MAPE_valid")}
    assert search.best_trial(trials).first()["run"] == "trial_0001"
    with pytest.raises(ValueError):
        search_runs(market, [{"lr": 0.1}])


def test_a_broken_search_goes_on(spark, market, tmp_path, monkeypatch):
    config = RunConfig(n_folds=2, features=("size", "city"), columns_to_add=(), size_backfill=False)
    settings = [{"max_depth": d, "iterations": 1} for d in (1, 2, 3)]
    folder, begun, own = str(tmp_path / "trials"), [], training.fit_and_score

    def fit(*arguments):
        begun.append(arguments[-1])
        if len(begun) == 2:
            raise RuntimeError("lost")
        return own(*arguments)

    monkeypatch.setattr(training, "fit_and_score", fit)
    with pytest.raises(RuntimeError):
        search_runs(market, settings[:2], config, folder=folder)
    assert begun[0] == "trial_0000"
    begun[:] = ["one", "two"]
    found = search_runs(market, settings, config, folder=folder, parallelism=2).collect()
    assert sorted(begun[2:]) == ["trial_0001", "trial_0002"]
    begun[:] = ["one", "two"]
    changed = search_runs(market, [settings[0], {"max_depth": 4, "iterations": 1}], config, folder=folder)
    assert begun[2:] == ["trial_0001"] and changed.count() == 4
    plain = {(r.run, r.metric): r.value for r in search_runs(market, settings, config, parallelism=3).collect()}
    assert len(plain) == 6 and {k: v for k, v in plain.items() if k[0] != "trial_0001"} == pytest.approx(
        {(r.run, r.metric): r.value for r in found if r.run != "trial_0001"}
    )


def test_fit_rows_are_judged_by_members_that_left_them_out(market, run):
    rows = run.scored.select("listing_id", "split", "prediction", models.LEFT_OUT, splits.fold(2).alias("fold")).collect()
    table = run.preparation.transform(market)
    apart = {}
    for i, member in enumerate(run.model.members):
        apart[i] = {r.listing_id: r.p for r in member.transform(table, "p").select("listing_id", "p").collect()}
    for r in rows:
        own = apart[r.fold][r.listing_id] if r.split == "train" else r.prediction
        assert r[models.LEFT_OUT] == pytest.approx(own, rel=1e-9)
    known = run.scored.where("split = 'train'").join(market.select("listing_id", F.col("price").alias("actual")), "listing_id")
    errors = [metrics.mape(known, "actual", c).first()["mape"] for c in ("prediction", models.LEFT_OUT)]
    assert errors[0] < errors[1]


def test_network_inputs_take_pseudo_labels(spark, market):
    labels = market.where("is_test").select("listing_id", F.lit(5000.0).alias("price"), (F.col("listing_id") % 2).cast("double").alias("uncertainty"))
    plain, more = network_inputs(market).rows, network_inputs(market, labels=labels).rows
    accepted = labels.where("uncertainty < 0.5").count()
    assert more.count() == plain.count() + accepted
    added = more.join(labels, "listing_id").where("split = 'train'")
    assert added.count() == accepted and added.where("abs(log_price - ln(5000)) > 1e-9").count() == 0


def test_settings_that_are_refused():
    with pytest.raises(ValueError):
        RunConfig(n_folds=1)
    with pytest.raises(ValueError):
        RunConfig(pseudo_labels=True)
    assert RunConfig(pseudo_labels=True, pseudo_labels_path="p").pseudo_label_source == "p"
    assert RunConfig(pseudo_labels="q").pseudo_label_source == "q" and RunConfig(pseudo_labels=False).pseudo_label_source is None
