"""Work that is done once for a row, not once per column, member or read."""

from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.functions import numeric, quantiles
from estatespark.operators import models, quantile_map
from estatespark.operators.target_statistics import count_categories
from estatespark.plans.network_inputs import network_inputs
from estatespark.schema import LISTING
from estatespark.verification.catalog import CHECKS
from estatespark.verification.views import view

SF_DIR = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(spark):
    listing = F.col("id").alias("listing_id")
    return spark.range(400).select(listing, (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 40).cast("string").alias("b"), (F.col("id") % 7 + 1.0).alias("price"))


def test_parts_are_drawn_before_rows_are_stacked(spark):
    rows = _rows(spark).withColumn("label", F.log("price"))
    counts = count_categories(rows, ["a", "b"], "label", models.part_of(2, 0))
    above, below = optimized(counts).split("Generate", 1)
    assert "md5" not in above and "md5" in below
    assert counts.agg(F.sum("n")).first()[0] == 800


def test_own_parts_are_drawn_once_for_all_members(spark, monkeypatch):
    """Written rows ask for a part's hash in one place, and hold the features that the encoder gives."""
    plans, as_table = [], models.as_table
    monkeypatch.setattr(models, "as_table", lambda df, label, partition_by=None: plans.append((label, optimized(df))) or as_table(df, label, partition_by))
    config = RunConfig(n_folds=2, one_hot_max_size=5)
    encoder, encoded = models._encoded(_rows(spark), ["price"], config, F.col("listing_id") % 5 == 0, ["a", "b"], True)
    # The row's fold, and the fold and finer hash of its part.
    assert dict(plans)["model-input"].count("md5") == 3
    known = models._labelled(_rows(spark), F.col("listing_id") % 5 == 0, config)
    own = F.when(~F.col("is_validation"), models.part_of(2, 0)).otherwise(-1)
    for member in range(2):
        found = encoded.select(F.col(f"features_{member}").alias("features"), "is_validation", "fold").collect()
        wanted = encoder.attach(known).select(encoder.features(member, own).alias("features"), "is_validation", "fold").collect()
        key = lambda r: (r["features"].toArray().tolist(), r["is_validation"], r["fold"])
        assert len(found) == 400 and sorted(map(key, found)) == sorted(map(key, wanted))


def test_rows_of_the_preprocessor_are_joined_once(spark):
    found = CHECKS["preprocessor"].run(spark, SF_DIR)
    assert not [f for f in found.inputFiles() if "lineitem" in f]
    assert found.count() == view(spark, SF_DIR, "listing").count()


def test_splits_of_network_inputs_are_drawn_once(spark):
    assert "md5" not in optimized(network_inputs(view(spark, SF_DIR, "listing")).rows)


def plans(df, capsys):
    df.explain(True)
    return capsys.readouterr().out.split("== Physical Plan ==")[1]


def test_a_quantile_map_is_no_generated_method_over_all_columns(spark, capsys):
    """Four mapped columns as column code are interpreted, not compiled. They go through Arrow batches, all in one."""
    columns = ["a", "b"]
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(60)] + [(60, float("nan"), float("inf")), (61, None, None)]
    df = spark.createDataFrame(rows, "listing_id bigint, a double, b double")
    fitted = quantile_map.fit_quantile_map(df.where("listing_id < 60"), columns, 10, "normal")
    mapped = fitted.transform(df, fill=False)
    found = {r["listing_id"]: r for r in mapped.collect()}
    assert plans(mapped, capsys).count("ArrowEvalPython") == 1
    bound = numeric.NORMAL_BOUND
    assert found[60]["a"] == found[60]["b"] == bound and found[0]["a"] == -bound
    assert found[61]["a"] is None and found[0]["b"] is None
    uniform = quantile_map.QuantileMap({"a": [0.0, 1.0, 1.0, 2.0, 4.0], "b": [3.0, 3.0], "c": []})
    few = spark.createDataFrame([(1.0, 3.0, 1.0), (3.0, 4.0, 1.0), (-1.0, None, None), (9.0, 2.0, None)], "a double, b double, c double")
    assert sorted(tuple(r) for r in uniform.transform(few).select("a", "c").collect()) == [(0.0, None), (0.375, None), (0.875, None), (1.0, None)]
    assert [r["b"] for r in uniform.transform(few).collect()] == [0.0, 1.0, None, 0.0]


def test_listings_are_read_once_and_members_score_in_one_pass(spark, capsys, monkeypatch):
    """A run writes its listings once, whatever lies below them, hashes each key once per seed and sends a row to Python once."""
    from estatespark.plans import training

    kinds = ["maison", "appartement", "terrain"]
    rows = [(i, kinds[i % 3], "x", 1000 + i % 4, float(10 + i % 9), i % 10 == 0, None if i % 10 == 0 else float(100 + 50 * (i % 3) + i % 7)) for i in range(600)]
    given = spark.createDataFrame(rows, "listing_id bigint, property_type string, city string, postal_code bigint, size double, is_test boolean, price double")
    types = {f.name: f.dataType for f in LISTING.fields}
    listings = given.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in given.columns})
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(key):
        seen.add(1)
        return key

    listings = listings.withColumn("listing_id", counted.asNondeterministic()("listing_id"))
    config = RunConfig(iterations=1, max_depth=1, features=("property_type", "size"), columns_to_add=(), early_stopping=False, size_backfill=False)
    run = training.run_trees(listings, config)
    assert run.metrics.count() == 2
    assert seen.value == 600
    plan = plans(run.metrics, capsys)
    assert plan.count("ArrowEvalPython") == 1 and "md5" not in plan
    assert not [c for c in run.scored.columns if "hash" in c]
    assert {r["split"] for r in run.scored.collect()} == {"train", "valid", "test"}
    # The members agree with their own predictions.
    single = run.model.members[0].transform(listings.where("is_test"), "one")
    assert single.where("one is null").count() == 0


def test_gathered_quantiles_are_those_of_percentile(spark):
    rows = [(f"g{i % 5}", float((i * i) % 97)) for i in range(500)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 1.0), ("g0", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    sizes = df.dropna().groupBy("k").agg(F.count("*").alias("n"))
    found = {r["k"]: list(r["quantiles"]) for r in quantiles.quantiles_by_group(df, ["k"], "x", (0.25, 0.5, 0.75), sizes).collect()}
    wanted = df.dropna().groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("q"))
    assert found == {r["k"]: list(r["q"]) for r in wanted.collect()}
    gathered = quantiles.quantiles_by_group(df, ["k"], "x", (0.5,), sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in gathered and "percentile" not in gathered
