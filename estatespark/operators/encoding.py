"""Scaling and category codes, fitted on one set of rows and applied to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatespark.schema import CATEGORICAL, CONTINUOUS
from estatespark.session import BroadcastBudget, as_table, fresh_path, joinable, value_bytes


@dataclass(frozen=True)
class StandardScaling:
    """Missing becomes 0, then (x - mean) / population deviation; a deviation of zero counts as one."""

    mean: Mapping[str, float]
    deviation: Mapping[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_zero_filled(c) - F.lit(m)) / F.lit(self.deviation[c]) for c, m in self.mean.items()})


def _zero_filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def fit_scaling(df: DataFrame, columns: Sequence[str] = CONTINUOUS) -> StandardScaling:
    """One aggregation over all columns."""
    row = df.agg(
        *[F.avg(_zero_filled(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(_zero_filled(c)).alias(f"{c}_std") for c in columns],
    ).first()
    return StandardScaling({c: row[f"{c}_mean"] or 0.0 for c in columns}, {c: row[f"{c}_std"] or 1.0 for c in columns})


def category_values(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Distinct (column, value) pairs without missing values: one scan, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def category_cardinality(df: DataFrame, columns: Sequence[str] = CATEGORICAL, approximate: bool = False) -> DataFrame:
    """(column, cardinality): distinct categories plus one for unknown values."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in columns])
        counted = row.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))
        )
    else:
        counted = category_values(df, columns).groupBy("column").agg(F.count("*").alias("n"))
    # A column without any value still has its code for unknown values.
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    known = names.join(counted, "column", "left")
    return known.select("column", (F.coalesce("n", F.lit(0)) + 1).alias("cardinality"))


def embedding_widths(cardinality: DataFrame, scale: float, widths: Mapping[str, int] | None = None) -> DataFrame:
    """(column, cardinality, width): cardinality / scale, at least 1, or the given widths where scale is not positive."""
    if scale > 0:
        width = F.greatest(F.lit(1), F.floor(F.col("cardinality") / F.lit(float(scale)))).cast("bigint")
        return cardinality.withColumn("width", width)
    if not widths:
        raise ValueError("without a positive scale every column needs an explicit width")
    given = cardinality.sparkSession.createDataFrame([(c, int(w)) for c, w in widths.items()], "column string, width bigint")
    return cardinality.join(given, "column")


@dataclass(frozen=True)
class OrdinalCodes:
    """Rank of a category among the sorted categories of its column.

    `unknown` is the code of missing and unseen values: "minus_one", or "count" for the number of known categories.
    """

    table: DataFrame
    dictionaries: Mapping[str, DataFrame]
    sizes: Mapping[str, int]
    unknown: str

    def only(self, columns: Sequence[str]) -> OrdinalCodes:
        return replace(self, sizes={c: self.sizes[c] for c in columns})

    def labels(self, columns: Sequence[str]) -> dict[str, list[str]]:
        """Sorted categories on the driver, for columns known to have few."""
        rows = self.table.where(F.col("column").isin(list(columns))).collect()
        return {c: [r["value"] for r in sorted(rows, key=lambda r: r["code"]) if r["column"] == c] for c in columns}

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Codes replace the categories, or go to columns with `suffix`."""
        for column, size in self.sizes.items():
            missing = F.lit(-1 if self.unknown == "minus_one" else size).cast("bigint")
            output = f"{column}{suffix}"
            if size == 0:
                df = df.withColumn(output, missing)
                continue
            codes = self.dictionaries[column].select(
                F.col("value").alias("dictionary_value"), F.col("code").alias("dictionary_code")
            )
            df = df.join(codes, F.col(column).cast("string") == F.col("dictionary_value"), "left")
            df = df.withColumn(output, F.coalesce("dictionary_code", missing)).drop("dictionary_value", "dictionary_code")
        return df


def rank_values(values: DataFrame) -> DataFrame:
    """(column, value, code) with codes 0.. in the byte order of the values.

    Values are dealt to ranges of (column, value) by their quantiles, whatever they begin with. A code is the value's rank in its
    range plus the number of the column's values in the ranges before.
    """
    # Written, so that the ranges are the same in both uses below.
    ranged = values.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    ranged = as_table(ranged, "categories")
    parts = ranged.groupBy("column", "part").agg(F.count("*").alias("w"))
    # One row per column and range.
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("column", "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("column", "part").orderBy("value")) - 1
    ranked = ranged.withColumn("inside", inside).join(parts, ["column", "part"])
    return ranked.select("column", "value", (F.col("start") + F.col("inside")).cast("bigint").alias("code"))


def fit_ordinal(df: DataFrame, columns: Sequence[str] = CATEGORICAL, unknown: str = "minus_one") -> OrdinalCodes:
    """One scan of `df`."""
    if unknown not in ("minus_one", "count"):
        raise ValueError("unknown must be 'minus_one' or 'count'")
    # One table per column: each join is decided by the size of its own dictionary.
    path = fresh_path(df.sparkSession, "dictionary")
    rank_values(category_values(df, columns)).write.partitionBy("column").parquet(path)
    return read_codes(df.sparkSession, path, columns, unknown)


def read_codes(spark: SparkSession, path: str, columns: Sequence[str], unknown: str) -> OrdinalCodes:
    """Dictionaries written as one folder per column."""
    schema = "value string, code bigint"
    written = spark.read.schema(f"column string, {schema}").parquet(path)
    measured = written.groupBy("column").agg(F.count("*").alias("n"), F.sum(value_bytes(written)).alias("size")).collect()
    sizes = {row["column"]: row["n"] for row in measured}
    budget = BroadcastBudget()
    dictionaries = {
        row["column"]: joinable(spark.read.schema(schema).parquet(f"{path}/column={row['column']}"), row["size"], budget)
        for row in measured
    }
    return OrdinalCodes(written, dictionaries, {c: sizes.get(c, 0) for c in columns}, unknown)


@dataclass(frozen=True)
class Preprocessor:
    """Scaling of continuous and codes of categorical columns, fitted on the same rows."""

    scaling: StandardScaling
    codes: OrdinalCodes

    def transform(self, df: DataFrame) -> DataFrame:
        return self.codes.transform(self.scaling.transform(df))


def fit_preprocessor(
    df: DataFrame,
    continuous: Sequence[str] = CONTINUOUS,
    categorical: Sequence[str] = CATEGORICAL,
    unknown: str = "minus_one",
) -> Preprocessor:
    return Preprocessor(fit_scaling(df, continuous), fit_ordinal(df, categorical, unknown))


