"""Error metrics and column summaries, each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.functions import quantiles
from estatespark.session import as_table

# Fixed value: smallest divisor of a percentage error.
EPSILON = 2.220446049250313e-16


def percentage_error(actual: Column, predicted: Column, guarded: bool = True) -> Column:
    """|actual - predicted| / |actual|; unguarded, a zero price gives NULL."""
    size = F.abs(actual)
    return F.abs(actual - predicted) / F.greatest(size, F.lit(EPSILON)) if guarded else F.try_divide(
        F.abs(actual - predicted), size
    )


def mape(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), guarded: bool = True) -> DataFrame:
    """Mean absolute percentage error of prices (not logarithms)."""
    present = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return present.groupBy(*by).agg(F.avg(percentage_error(F.col(actual), F.col(predicted), guarded)).alias("mape"))


def mae_mse(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), log_scale: bool = False) -> DataFrame:
    """Mean absolute and squared error, of prices or of their logarithms."""
    a, p = F.col(actual), F.col(predicted)
    present = df.where(a.isNotNull() & p.isNotNull())
    if log_scale:
        present = present.where((a > 0) & (p > 0))
        a, p = F.log(a), F.log(p)
    return present.groupBy(*by).agg(F.avg(F.abs(a - p)).alias("mae"), F.avg((a - p) * (a - p)).alias("mse"))


def metrics_by_split(df: DataFrame, split: str, actual: str, predicted: str) -> DataFrame:
    """(metric, value) rows such as MAPE_train and MAPE_valid."""
    found = mape(df, actual, predicted, [split])
    return found.select(F.concat(F.lit("MAPE_"), F.col(split)).alias("metric"), F.col("mape").alias("value"))


def metric_rows(df: DataFrame, run: str) -> DataFrame:
    return df.select(F.lit(run).alias("run"), "metric", F.col("value").cast("double").alias("value"))


def feature_count(df: DataFrame, key: str) -> int:
    return len([c for c in df.columns if c != key])


def best_run(trials: DataFrame, metric: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """The run with the lowest metric; ties go to the smaller run name."""
    return trials.groupBy(*by).agg(
        F.min(F.struct(F.col(metric), F.col("run"))).alias("best")
    ).select(*by, F.col("best.run").alias("run"), F.col(f"best.{metric}").alias(metric))


def describe(df: DataFrame, columns: Sequence[str], direct_rows: int = quantiles.DIRECT_ROWS) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) with exact quartiles."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    stacked = df.select(F.inline(pairs))
    x = F.col("x")
    moments = as_table(
        stacked.groupBy("column").agg(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ),
        "describe",
    )
    points = quantiles.quantiles_by_group(stacked, ["column"], "x", (0.25, 0.5, 0.75), moments.select("column", "n"), direct_rows)
    named = points.select("column", *[F.col("quantiles")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))])
    return moments.join(named, "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")
