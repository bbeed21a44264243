"""Densities and price-per-square-metre statistics of areas, and their join back to listings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.functions import quantiles
from estatespark.functions.numeric import safe_ratio
from estatespark.schema import AREA_LEVELS, PRICE_STATISTICS
from estatespark.session import BroadcastBudget, as_table, as_tables

QUARTILES = (0.25, 0.5, 0.75)


def postal_density(df: DataFrame) -> DataFrame:
    """Listings per postal code."""
    return df.where(F.col("postal_code").isNotNull()).groupBy("postal_code").agg(F.count("*").alias("density"))


def department_density(df: DataFrame) -> DataFrame:
    """Listings per department."""
    return df.where(F.col("department").isNotNull()).groupBy("department").agg(
        F.count("*").alias("density_department")
    )


def join_densities(df: DataFrame, postal: DataFrame, departments: DataFrame) -> DataFrame:
    joined = df.join(postal, "postal_code", "left").join(departments, "department", "left")
    return joined.withColumn("density_ratio", safe_ratio(F.col("density"), F.col("density_department")))


GROUP = ("level", "area", "property_type")


def stack_levels(df: DataFrame, *columns: str) -> DataFrame:
    """One row per listing and area level, so that one scan and one shuffle serve all levels."""
    areas = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.col(column).cast("string").alias("area"))
            for level, column in AREA_LEVELS.items()
        ]
    )
    return df.select(F.inline(areas), *columns).where(F.col("area").isNotNull())


def price_rows(df: DataFrame, fit_rows: Column) -> DataFrame:
    """(level, area, property_type, price_m2) of fit listings, nothing missing."""
    usable = fit_rows & F.col("price_m2").isNotNull() & F.col("property_type").isNotNull()
    return stack_levels(df.where(usable), "property_type", "price_m2")


def price_moments(rows: DataFrame) -> DataFrame:
    """Rows of any split, and count, mean and sample deviation of the prices, per group.

    All of these combine before the shuffle, so a hot area costs nothing extra.
    """
    value = F.col("price_m2")
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("listings"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def price_quantiles(rows: DataFrame, group_rows: DataFrame, direct_rows: int = quantiles.DIRECT_ROWS) -> DataFrame:
    points = quantiles.quantiles_by_group(rows, GROUP, "price_m2", QUARTILES, group_rows, direct_rows)
    quartiles = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return points.select(*GROUP, *quartiles)


@dataclass(frozen=True)
class AreaStatistics:
    """Fitted statistics, ready to join: (postal_code, density), (department, density) and one table per level."""

    postal: DataFrame
    departments: DataFrame
    prices: Mapping[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        df = join_densities(df, self.postal, self.departments)
        for level, table in self.prices.items():
            df = df.join(table, [AREA_LEVELS[level], "property_type"], "left")
        return df


def fit_area_statistics(
    df: DataFrame, fit_rows: Column, direct_rows: int = quantiles.DIRECT_ROWS, written: bool = False
) -> AreaStatistics:
    """`df` needs department and price_m2. Densities count all rows, price statistics only `fit_rows`.

    The few columns that the statistics need are written once; both aggregations read that table, never `df` again. Where `df` reads
    a `written` table itself, both read that one.
    """
    price = F.when(fit_rows, F.col("price_m2")).alias("price_m2")
    narrow = df.select(*AREA_LEVELS.values(), "property_type", price)
    narrow = narrow if written else as_table(narrow, "area-prices")
    moments = as_table(price_moments(stack_levels(narrow, "property_type", "price_m2")), "price-moments")
    spread = price_quantiles(price_rows(narrow, F.lit(True)), moments.select(*GROUP, "n"), direct_rows)
    statistics = moments.where((F.col("n") > 0) & F.col("property_type").isNotNull()).join(spread, list(GROUP), "left")
    budget = BroadcastBudget()
    by_level = as_tables(statistics.drop("listings", "n"), "price-statistics", "level", list(AREA_LEVELS), budget)
    # Groups of one area differ in the property type only.
    areas = moments.where(F.col("level") != "city").groupBy("level", "area").agg(F.sum("listings").alias("n"))
    density = as_tables(areas, "density", "level", ["zipcode", "deptcode"], budget)
    return AreaStatistics(
        density["zipcode"].select(_area("zipcode", df), F.col("n").alias("density")),
        density["deptcode"].select(_area("deptcode", df), F.col("n").alias("density_department")),
        {level: _named(table, level, df) for level, table in by_level.items()},
    )


def _area(level: str, df: DataFrame) -> Column:
    column = AREA_LEVELS[level]
    return F.col("area").cast(df.schema[column].dataType).alias(column)


def _named(table: DataFrame, level: str, df: DataFrame) -> DataFrame:
    statistics = [F.col(stat).alias(name.format(level)) for stat, name in PRICE_STATISTICS.items()]
    return table.select(_area(level, df), "property_type", *statistics)
