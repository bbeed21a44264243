import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatespark.functions import quantiles
from estatespark.functions.numeric import with_normal_quantile
from estatespark.operators import quantile_map
from estatespark.session import as_table

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed():
    """One group with a third of all rows, heavy ties, negative values, huge and tiny values, a one-row group."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.exp(rng.normal(0, 6, 3000)) * rng.choice([-1, 1], 3000)]
    rows += [("ties", float(v)) for v in rng.integers(-3, 4, 2000)]
    rows += [("narrow", 2000.0 + float(v) * 1e-9) for v in rng.random(1500)]
    rows += [("flat", 7.5)] * 1000 + [("one", -1.25)] + [("hot", None), (None, 4.0)]
    return rows


def _expected(rows, key):
    return np.quantile([v for k, v in rows if k == key and v is not None], PROBABILITIES)


@pytest.mark.parametrize("direct_rows", [0, 1200, 10**6])
def test_any_size_gives_the_exact_quantiles(spark, skewed, direct_rows):
    df = spark.createDataFrame(skewed, "k string, v double").repartition(5)
    sizes = as_table(df.dropna().groupBy("k").agg(F.count("*").alias("n")), "sizes")
    result = quantiles.quantiles_by_group(df, ["k"], "v", PROBABILITIES, sizes, direct_rows)
    found = {r["k"]: r["quantiles"] for r in result.collect()}
    assert set(found) == {"hot", "ties", "narrow", "flat", "one"}
    for key, values in found.items():
        np.testing.assert_allclose(values, _expected(skewed, key), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("direct_rows", [0, 10**6])
def test_weights_stand_for_repeated_values(spark, skewed, direct_rows):
    df = spark.createDataFrame(skewed, "k string, v double").dropna()
    counted = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    sizes = as_table(counted.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    result = quantiles.quantiles_by_group(counted, ["k"], "v", PROBABILITIES, sizes, direct_rows, "w")
    for row in result.collect():
        np.testing.assert_allclose(row["quantiles"], _expected(skewed, row["k"]), rtol=1e-12, atol=1e-12)


def test_values_near_zero_and_in_one_cell(spark, monkeypatch):
    """Many values of 1e-9 beside one of 0.015, and many next to each other: cells are cut until they are small."""
    monkeypatch.setattr(quantiles, "CELL_VALUES", 50)
    rows = [("zero", i * 1e-13) for i in range(4000)] + [("zero", 0.015), ("zero", -3.0)]
    rows += [("close", 1.0 + i * 1e-12) for i in range(4000)] + [("signs", (i - 2000) * 1e-300) for i in range(4001)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    sizes = as_table(df.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    for row in quantiles.quantiles_by_group(df, ["k"], "v", PROBABILITIES, sizes, 0).collect():
        np.testing.assert_allclose(row["quantiles"], _expected(rows, row["k"]), rtol=1e-12, atol=1e-312)


def test_limit_between_the_two_ways(spark):
    """The same quantiles just below, at and above the number of rows that changes the way."""
    rows = [("g", float(v)) for v in np.random.default_rng(1).normal(size=500)]
    df = spark.createDataFrame(rows, "k string, v double")
    sizes = as_table(df.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    found = [quantiles.quantiles_by_group(df, ["k"], "v", PROBABILITIES, sizes, n).first()["quantiles"] for n in (499, 500, 501)]
    for values in found[1:]:
        np.testing.assert_allclose(values, found[0], rtol=1e-12)


def test_normal_quantile(spark):
    points = [1e-7, 1e-5, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-7]
    df = spark.createDataFrame([(p, p) for p in points] + [(-1.0, 0.0), (-2.0, 1.0), (-3.0, None)], "k double, p double")
    found = {r["k"]: r["p"] for r in with_normal_quantile(df, ["p"]).collect()}
    for p in points:
        assert found[p] == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-9)
    assert found[-1.0] == -found[-2.0] == -5.1993375821928165
    assert found[-3.0] is None


def _reference_rank(x, fit, n_quantiles):
    """Mean of the forward and the backward interpolation between the knots."""
    n = min(n_quantiles, len(fit))
    rank = np.linspace(0, 1, n)
    knots = np.quantile([v for v in fit if v is not None], rank)
    if x <= knots[0]:
        return 0.0
    if x >= knots[-1]:
        return 1.0
    return 0.5 * (np.interp(x, knots, rank) - np.interp(-x, -knots[::-1], -rank[::-1]))


def test_quantile_map_follows_both_interpolations(spark):
    rng = np.random.default_rng(5)
    fit = [float(v) for v in np.round(rng.gamma(2, 30, 400))] + [None] * 20 + [40.0] * 60
    new = [float(v) for v in rng.uniform(-5, 300, 200)] + fit[:50]
    df = spark.createDataFrame([(v,) for v in fit], "x double")
    fitted = quantile_map.fit_quantile_map(df, ["x"], n_quantiles=37)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(new)], "i int, x double")
    for row in fitted.transform(rows, fill=False).collect():
        if new[row["i"]] is None:
            assert row["x"] is None
        else:
            assert row["x"] == pytest.approx(_reference_rank(new[row["i"]], fit, 37), abs=1e-12)


def test_fill_value_for_missing(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (None,)], "x double")
    plain = quantile_map.fit_quantile_map(df, ["x"], n_quantiles=3)
    # Mapped values 0, 0.5, 1: minimum 0, sample deviation 0.5.
    assert plain.fills["x"] == pytest.approx(-0.5)
    again = quantile_map.fit_quantile_map(df, ["x"], n_quantiles=3, refill=True)
    filled = [0.0, 0.5, 1.0, -0.5, -0.5]
    assert again.test_fills["x"] == pytest.approx(-0.5 - statistics.stdev(filled))
    rows = spark.createDataFrame([(None, True), (None, False), (2.0, True)], "x double, t boolean")
    values = [r["x"] for r in again.transform(rows, is_test=F.col("t")).collect()]
    assert values == pytest.approx([again.test_fills["x"], -0.5, 1.0])


def test_normal_fill_value_for_missing(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (None,)], "x double")
    fitted = quantile_map.fit_quantile_map(df, ["x"], n_quantiles=3, output="normal")
    bound = 5.1993375821928165
    assert fitted.fills["x"] == pytest.approx(-bound - math.sqrt(2 * bound**2 / 2))


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "x double, y double")
    fitted = quantile_map.fit_quantile_map(df, ["x", "y"], n_quantiles=10)
    rows = spark.createDataFrame([(2.0, 1.0), (3.0, None), (4.0, None), (None, None)], "x double, y double")
    assert [r["x"] for r in fitted.transform(rows, fill=False).collect()] == [0.0, 0.0, 1.0, None]
    assert all(r["y"] is None for r in fitted.transform(rows, fill=False).collect())


def test_price_rows_that_are_read_several_times_come_from_a_narrow_table(spark):
    from estatespark.verification import tabular

    rows = tabular._written_price_rows(spark, "/root/testdata/sf0.001")
    plain = tabular._price_rows(spark, "/root/testdata/sf0.001")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.dtypes == plain.dtypes and rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
