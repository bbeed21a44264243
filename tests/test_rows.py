"""Single-row operators, splits, codes and joins on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from estatespark.config import config_from_mapping, load_config
from estatespark.functions import numeric
from estatespark.operators import area_stats, encoding, metrics, projections, pseudo_labels, splits
from estatespark.plans.enrichment import base_features, enrich
from estatespark.schema import CATEGORICAL, CONTINUOUS, FEATURES, LABELS, LISTING
from estatespark.sources import sinks, tables


def values(df, column):
    return [r[column] for r in df.collect()]


def test_division_by_zero_and_missing_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0)], "size double, land_size double")
    assert values(projections.add_size_ratio(df), "size_ratio") == [None, None, None, 1.5]


def test_photo_cap_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (2.0,), (9.0,)], "nb_photos double")
    assert values(projections.add_nb_photos_clean(df), "nb_photos_clean") == [None, 2.0, 6.0]


def test_clip_bounds(spark):
    df = spark.createDataFrame([(None, 1.0), (20.0, 3.0)], "nb_rooms double, nb_bedrooms double")
    both = projections.clip_columns(df, lower=2, upper=10)
    assert [(r[0], r[1]) for r in both.collect()] == [(None, 2.0), (10.0, 3.0)]
    # One bound only is a lower bound: it raises every smaller count.
    lower = projections.clip_columns(df, lower=15)
    assert [(r[0], r[1]) for r in lower.collect()] == [(None, 15.0), (20.0, 15.0)]


def test_log_of_impossible_prices_is_missing(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (math.e,)], "price double")
    assert values(projections.log_target(df), "label") == [None, None, None, pytest.approx(1.0)]


def test_department_of_short_and_missing_codes(spark):
    df = spark.createDataFrame([(1000,), (75011,), (None,)], "postal_code bigint")
    assert values(projections.add_department(df), "department") == ["01", "75", None]


def test_size_cutoff_is_strict_and_for_homes_only(spark):
    rows = [("maison", 1000.0), ("maison", 1000.5), ("parking", 5000.0), (None, 5000.0)]
    df = spark.createDataFrame(rows, "property_type string, size double")
    assert values(projections.add_size_clean(df), "size_clean") == [1000.0, None, 5000.0, 5000.0]


def test_fill_defaults_types_and_order(spark):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEATURES.fields) + ", department string"
    empty = spark.createDataFrame([(1, *[None] * (len(FEATURES.fields)))], schema)
    row = projections.fill_defaults(empty).first().asDict()
    assert row["energy_performance_value"] == -1.0 and row["ghg_value"] == -1.0
    assert all(row[c] == 0.0 for c in CONTINUOUS if c not in ("energy_performance_value", "ghg_value"))
    assert all(row[c] == "-1" for c in CATEGORICAL)


def test_rooms_from_bedrooms(spark):
    df = spark.createDataFrame([(None, 2.0), (5.0, 2.0), (None, None)], "nb_rooms double, nb_bedrooms double")
    assert values(projections.fill_rooms(df), "nb_rooms") == [3.0, 5.0, None]


def test_model_columns():
    continuous, categorical = projections.model_columns(["density"], True, n_image_features=3)
    assert continuous[-4:] == ["image_feature_0", "image_feature_1", "image_feature_2", "density"]
    assert "size" not in continuous and categorical == list(CATEGORICAL)
    assert projections.model_columns([], False, 3, 2)[0][-2:] == ["pca_feature_0", "pca_feature_1"]


def test_splits_are_stable_and_sized(spark):
    df = spark.range(20000).select(F.col("id").alias("listing_id"), F.lit(False).alias("is_test"))
    share = df.where(splits.is_holdout()).count() / 20000
    assert share == pytest.approx(0.2, abs=0.01)
    other = df.where(splits.is_holdout(seed=5)).join(df.where(splits.is_holdout()), "listing_id").count() / 20000
    assert other == pytest.approx(0.04, abs=0.01)
    folds = df.where(splits.is_fit()).groupBy(splits.fold().alias("f")).count().collect()
    assert sorted(r["f"] for r in folds) == [0, 1, 2]
    assert df.repartition(7).where(splits.is_holdout()).count() == df.where(splits.is_holdout()).count()
    assert df.where(splits.is_holdout()).agg(F.max(splits.split_name())).first()[0] == "valid"


def test_small_shares_are_not_rounded_away(spark):
    df = spark.range(200000).withColumnRenamed("id", "listing_id")
    assert 40 < splits.hash_sample(df, 0.0004).count() < 130


def test_union_and_cut_keep_duplicates(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 2.0)], "listing_id bigint, price double")
    test = spark.createDataFrame([(1,), (3,)], "listing_id bigint")
    both = splits.union_splits(train, test)
    assert both.count() == 4
    again, rest = splits.cut_splits(both)
    assert again.count() == 2 and sorted(values(rest, "listing_id")) == [1, 3]


def test_population_deviation_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, 4.0)], "a double, b double")
    fitted = encoding.fit_scaling(df, ["a", "b"])
    assert fitted.mean["a"] == pytest.approx(4 / 3)
    assert fitted.deviation["a"] == pytest.approx(math.sqrt(((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (4 / 3) ** 2) / 3))
    assert values(fitted.transform(df), "b") == [0.0, 0.0, 0.0]


def test_codes_follow_the_sorted_categories(spark):
    fit = spark.createDataFrame([("b", None), ("abc1", None), ("abc2", None), ("é", None), ("b", None), (None, None)], "c string, e string")
    new = spark.createDataFrame([("abc2", "x"), ("zz", None), (None, None), ("é", None), ("b", None)], "c string, e string")
    order = {v: i for i, v in enumerate(sorted({"b", "abc1", "abc2", "é"}))}
    for unknown, code in (("minus_one", -1), ("count", 4)):
        found = encoding.fit_ordinal(fit, ["c", "e"], unknown).transform(new)
        assert [r["c"] for r in found.orderBy("c").collect()].count(code) == 2
        assert sorted(values(found, "c")) == sorted([order["abc2"], code, code, order["é"], order["b"]])
        assert set(values(found, "e")) == {-1 if unknown == "minus_one" else 0}


def test_cardinality_and_widths(spark):
    df = spark.createDataFrame([("a", None), ("b", None), (None, None)], "c string, e string")
    for approximate in (False, True):
        found = {r["column"]: r["cardinality"] for r in encoding.category_cardinality(df, ["c", "e"], approximate).collect()}
        assert found == {"c": 3, "e": 1}
    sizes = spark.createDataFrame([("feature_a", 100), ("feature_b", 50), ("feature_c", 4)], "column string, cardinality bigint")
    assert values(encoding.embedding_widths(sizes, 10), "width") == [10, 5, 1]
    given = encoding.embedding_widths(sizes, -1, {"feature_a": 7, "feature_b": 2, "feature_c": 1})
    assert {r["column"]: r["width"] for r in given.collect()} == {"feature_a": 7, "feature_b": 2, "feature_c": 1}
    with pytest.raises(ValueError):
        encoding.embedding_widths(sizes, -1)


def listing(**changes):
    row = {f.name: None for f in LISTING.fields}
    row.update(listing_id=0, property_type="maison", city="X", postal_code=1000, price=None, is_test=False)
    row.update(changes)
    return tuple(row[f.name] for f in LISTING.fields)


def test_enrichment_by_hand(spark):
    fit_ids, valid_ids = [], []
    for r in spark.range(60).select("id", splits.is_holdout(key="id").alias("v")).collect():
        (valid_ids if r["v"] else fit_ids).append(r["id"])
    a, b, c, d = fit_ids[:4]
    rows = [
        listing(listing_id=a, size=10.0, price=100.0, land_size=5.0),
        listing(listing_id=b, size=10.0, price=300.0, land_size=0.0, nb_photos=8.0),
        listing(listing_id=c, size=2000.0, price=400.0, land_size=4.0),
        listing(listing_id=d, property_type=None, postal_code=2000, size=1.0, price=50.0),
        listing(listing_id=valid_ids[0], size=1.0, price=9999.0),
        listing(listing_id=valid_ids[1], size=5000.0, price=1.0),
        listing(listing_id=1000, postal_code=1000, is_test=True, size=None),
        listing(listing_id=1001, postal_code=None, is_test=True, size=3.0),
    ]
    found = {r["listing_id"]: r for r in enrich(spark.createDataFrame(rows, LISTING)).collect()}
    assert len(found) == 8
    # Validation prices are not seen; test rows get the statistics.
    for key in (a, b, c, valid_ids[0], 1000):
        assert found[key]["price_m2_type_zipcode"] == 20.0
        assert found[key]["price_m2_type_zipcode25"] == 15.0
        assert found[key]["price_m2_type_zipcode_std"] == pytest.approx(math.sqrt(200))
        assert (found[key]["density"], found[key]["density_department"]) == (6, 6)
    assert found[d]["price_m2_type_zipcode"] is None and found[d]["price_m2_type_city"] is None
    assert (found[d]["density"], found[d]["density_department"], found[d]["density_ratio"]) == (1, 1, 1.0)
    assert found[1001]["density"] is None and found[1001]["price_m2_type_deptcode"] is None
    assert found[1001]["price_m2_type_city"] == 20.0
    # The size above the cutoff is removed, and filled from the price on fit rows only.
    assert found[c]["size_clean"] == 20.0 and found[c]["size_ratio_clean"] == 5.0
    assert found[valid_ids[1]]["size_clean"] is None
    assert found[b]["size_ratio"] is None and found[b]["nb_photos_clean"] == 6.0
    plain = enrich(spark.createDataFrame(rows, LISTING), size_backfill=False)
    assert plain.where(F.col("listing_id") == c).first()["size_clean"] is None


def test_large_areas_give_the_same_statistics(spark):
    rows = [listing(listing_id=i, postal_code=1000 + (i % 3 if i % 4 else 0), size=1.0 + i % 7, price=100.0 + i * i % 977) for i in range(400)]
    df = spark.createDataFrame(rows, LISTING)
    few, many = (
        sorted(tuple(r) for r in enrich(df, direct_rows=n).select("listing_id", "price_m2_type_zipcode25", "price_m2_type_city75").collect())
        for n in (5, 10**6)
    )
    assert [value for row in few for value in row] == pytest.approx([value for row in many for value in row])


def test_pseudo_labels_are_matched_by_key(spark):
    fit = spark.createDataFrame([(1, 10.0, 5.0)], "listing_id bigint, size double, price double")
    test = spark.createDataFrame([(2, 20.0), (3, 30.0), (4, 40.0)], "listing_id bigint, size double").withColumn(
        "price", F.lit(None).cast("double")
    )
    labels = spark.createDataFrame([(4, 8.0, 0.1), (3, 7.0, 0.5), (2, 6.0, None)], "listing_id bigint, price double, uncertainty double")
    found = pseudo_labels.append_pseudo_labels(fit, test, labels)
    assert sorted((r["listing_id"], r["size"], r["price"]) for r in found.collect()) == [(1, 10.0, 5.0), (4, 40.0, 8.0)]


def test_percentage_errors(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 5.0), (None, 1.0)], "a double, p double")
    assert metrics.mape(df, "a", "p").first()["mape"] == pytest.approx(0.375)
    zero = spark.createDataFrame([(0.0, 1.0), (4.0, 5.0)], "a double, p double")
    assert metrics.mape(zero, "a", "p", guarded=False).first()["mape"] == pytest.approx(0.25)
    assert metrics.mape(zero, "a", "p").first()["mape"] > 1e15
    scale = metrics.mae_mse(df, "a", "p").first()
    assert (scale["mae"], scale["mse"]) == (1.0, 1.0)
    logs = metrics.mae_mse(df, "a", "p", log_scale=True).first()
    assert logs["mae"] == pytest.approx((math.log(2) + math.log(1.25)) / 2)


def test_one_row_has_no_deviation(spark):
    df = spark.createDataFrame([("l", "x", "t", 3.0)], "level string, area string, property_type string, price_m2 double")
    assert area_stats.price_moments(df).first()["std"] is None


def test_csv_round_trip_and_bad_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], LABELS)
    path = str(tmp_path / "labels.csv")
    sinks.write_submission(df, path)
    assert sorted(tables.read_table(spark, path, LABELS).collect()) == sorted(df.collect())
    bad = tmp_path / "bad.csv"
    bad.write_text("listing_id,price\n1,abc\n")
    with pytest.raises(Exception):
        tables.read_table(spark, str(bad), LABELS).collect()
    with pytest.raises(ValueError):
        tables.read_table(spark, path)
    with pytest.raises(ValueError):
        tables.read_keyed(spark, "/root/testdata/sf0.001/nation.parquet", None, "listing_id")


def test_parquet_columns_are_declared(spark):
    schema = FEATURES
    with pytest.raises(ValueError):
        tables.read_table(spark, "/root/testdata/sf0.001/nation.parquet", schema)


def test_config_reads_nested_settings(tmp_path):
    path = tmp_path / "config.yml"
    path.write_text(
        "tags:\n  - x\nvalid_size: 0.3\nclip_rooms: null\ncolumns_to_add: null\nim_size: !!python/tuple [64,32]\n"
        "embed_dims:\n  city_embed_dim: 9\nmodel_params:\n  iterations: 7\n  lr: 0.02\n"
    )
    config = load_config(str(path))
    assert (config.valid_size, config.iterations, config.im_size) == (0.3, 7, (64, 32))
    assert config.embed_dims == {"city": 9} and config.columns_to_add == () and config.clip_rooms is None
    assert config_from_mapping({"clip_rooms": 15}).clip_rooms == (15, None)
    with pytest.raises(ValueError):
        config_from_mapping({"quantile_transform": "other"})


def test_area_columns_survive_a_join(spark):
    rows = [listing(listing_id=i, size=1.0, price=1.0) for i in range(3)]
    base = base_features(spark.createDataFrame(rows, LISTING))
    assert base.select(numeric.department(F.col("postal_code"))).first()[0] == "01"


def test_codes_of_values_that_begin_alike(spark):
    """Ranks come from ranges of the values, so a beginning that all share does no harm."""
    values = [("c", f"https://example.org/{i:05d}") for i in range(3000)] + [("d", f"{i % 7}") for i in range(50)] + [("c", None)]
    df = spark.createDataFrame(values, "name string, value string")
    wide = df.select(F.when(F.col("name") == "c", F.col("value")).alias("c"), F.when(F.col("name") == "d", F.col("value")).alias("d"))
    codes = encoding.fit_ordinal(wide.repartition(5), ["c", "d"])
    assert dict(codes.sizes) == {"c": 3000, "d": 7}
    found = {r["value"]: r["code"] for r in codes.table.where(F.col("column") == "c").collect()}
    assert found == {f"https://example.org/{i:05d}": i for i in range(3000)}


def test_shares_too_small_to_split(spark):
    with pytest.raises(ValueError):
        splits.hash_sample(spark.range(1).withColumnRenamed("id", "listing_id"), 1e-9)
