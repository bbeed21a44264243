"""Exact quantiles per group, also where one group holds a large share of all rows.

Gathering the values of a group in one task is the fastest way for groups of bounded size and is used for those. Larger groups are narrowed by counting: rows are counted in cells whose edges depend on
the data only through minima and maxima, so that recomputing a lost task gives the same cells; only the few cells that
hold a wanted rank go on to the next step. No step brings a group's rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatespark.session import as_table, joinable

# Groups of up to this many rows are gathered in one task.
DIRECT_ROWS = 1_000_000
# Cells per factor of two of the value in the first step, parts of a cell in each further step, and the most distinct values of a
# cell that one task sorts.
OCTAVE_CELLS = 64
SUB_CELLS = 4096
CELL_VALUES = 100_000


def quantiles_by_group(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    group_rows: DataFrame,
    direct_rows: int = DIRECT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """(keys, quantiles array) with linear interpolation between neighbouring ranks.

    `group_rows` is a written table of (keys, n): the number of rows of each group in `df`. A row stands for `weight` equal
    values, if given. Rows whose key or value is missing are left out.
    """
    repeats = F.lit(1) if weight is None else F.col(weight)
    present = df.select(*keys, F.col(value).cast("double").alias("v"), repeats.cast("bigint").alias("repeats")).dropna()
    large = group_rows.where(F.col("n") > direct_rows).select(*keys)
    if large.isEmpty():
        return _direct(present, keys, probabilities, weight is not None)
    # At most (all rows / direct_rows) rows.
    large = joinable(as_table(large, "large-groups"))
    small_part = _direct(present.join(large, list(keys), "left_anti"), keys, probabilities, weight is not None)
    large_part = _narrowed(present.join(large, list(keys), "left_semi"), list(keys), probabilities)
    return small_part.unionByName(large_part)


def _direct(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], weighted: bool) -> DataFrame:
    if weighted:
        points = F.lit(np.asarray(probabilities, dtype=float))
        return rows.groupBy(*keys).agg(F.percentile("v", points, F.col("repeats")).alias("quantiles"))
    # A group's values as one sorted array, as `percentile` counts each value in a map. The number in front lets tasks sort their rows
    # by it, not by texts.
    code = F.xxhash64(*keys).alias("group_code")
    gathered = rows.groupBy(code, *keys).agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    return gathered.select(*keys, F.array(*[_between(p) for p in probabilities]).alias("quantiles"))


def _between(probability: float) -> Column:
    """The value at a position of the array `sorted`, between its neighbours as `percentile` has it."""
    position = (F.size("sorted") - 1) * F.lit(float(probability))
    low, high = F.floor(position), F.ceil(position)
    below, above = F.get(F.col("sorted"), low.cast("int")), F.get(F.col("sorted"), high.cast("int"))
    return F.when((low == high) | (below == above), below).otherwise((high - position) * below + (position - low) * above)


def medians_by_group(
    df: DataFrame, key: str, value: str, weight: str | None, n_rows: int, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """(key, median) of groups in `n_rows` rows together; missing values are left out.

    Without weights the median lies between the two middle values. With positive weights it is the value in whose place half of
    the group's weight is reached: the last one with no more than half of the weight below it.
    """
    mass = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(key, F.col(value).cast("double").alias("v"), mass.alias("repeats")).dropna()
    if weight is None:
        if n_rows <= direct_rows:
            return rows.groupBy(key).agg(F.percentile("v", F.lit(0.5)).alias("median"))
        sizes = as_table(rows.groupBy(key).agg(F.count("*").alias("n")), "group-sizes")
        found = quantiles_by_group(df, [key], value, [0.5], sizes, direct_rows)
        return found.select(key, F.col("quantiles")[0].alias("median"))
    rows = rows.where("repeats > 0")
    if n_rows > direct_rows:
        return _narrowed(rows, [key], [0.5], _half_masses).select(key, F.col("quantiles")[0].alias("median"))
    # No group has more rows than there are.
    ordered = Window.partitionBy(key).orderBy("v")
    below = F.coalesce(F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    counted = rows.groupBy(key, "v").agg(F.sum("repeats").alias("w")).withColumn("below", below)
    half = counted.withColumn("half", F.sum("w").over(Window.partitionBy(key)) / 2)
    return half.where("below <= half").groupBy(key).agg(F.max("v").alias("median"))


def _half_masses(cells: DataFrame, keys: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Half of each group's weight as the wanted rank, on both sides, so that nothing lies between."""
    totals = cells.groupBy(*keys).agg((F.sum("w") / 2).alias("rank"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    return totals.select(*keys, F.lit(0).alias("i"), sides, F.lit(0.0).alias("share"), "rank")


def _narrowed(rows: DataFrame, keys: list[str], probabilities: Sequence[float], asked: Callable | None = None) -> DataFrame:
    """The counting way, for groups of any size. `rows` (keys, v, repeats) is read twice; `asked` gives the wanted ranks."""
    v, count = F.col("v"), F.sum("repeats").alias("w")

    # OCTAVE_CELLS per factor of two on either side of zero: at most 2 * 2100 * OCTAVE_CELLS cells for any rows.
    steps = F.floor((F.log2(F.abs(v)) + 1075) * OCTAVE_CELLS) + 1
    cell = F.when(v == 0, 0).when(v > 0, steps).otherwise(-steps).cast("bigint")
    rows = rows.withColumn("cell", cell)
    cells = as_table(rows.groupBy(*keys, "cell").agg(count), "quantile-cells")
    wished = (asked or _ranks)(cells, keys, probabilities)
    ranks = as_table(_place(wished, cells, keys, "cell"), "quantile-ranks")
    wanted = joinable(as_table(ranks.select(*keys, "cell").distinct(), "quantile-cells"))
    # Written are the distinct values of the wanted cells, counted before the shuffle, so that ties cost nothing.
    values = rows.join(wanted, [*keys, "cell"]).groupBy(*keys, "cell", "v").agg(count)
    values = as_table(values, "quantile-values")
    spot = [*keys, "cell"]
    while True:
        # Cells are cut between their own smallest and largest value until each holds few distinct values.
        bounds = values.groupBy(*spot).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"))
        bounds = as_table(bounds, "quantile-cells")
        if bounds.where(F.col("size") > CELL_VALUES).isEmpty():
            break
        share = F.try_divide(v - F.col("low"), F.col("high") - F.col("low"))
        cut = values.join(joinable(bounds), spot).withColumn("sub_cell", F.coalesce(F.floor(share * SUB_CELLS), F.lit(0)))
        sub_cells = cut.groupBy(*spot, "sub_cell").agg(F.sum("w").alias("w"))
        ranks = as_table(_place(ranks, sub_cells, spot, "sub_cell"), "quantile-ranks")
        kept = cut.join(ranks.select(*spot, "sub_cell").distinct(), [*spot, "sub_cell"])
        # A kept part of a cell is a cell of its own, named by its old cell and its place.
        name = F.xxhash64("cell", "sub_cell")
        values = as_table(kept.select(*keys, name.alias("cell"), "v", "w"), "quantile-values")
        ranks = as_table(ranks.withColumn("cell", name).drop("sub_cell"), "quantile-ranks")

    ranks = _place(ranks, values, spot, "v")

    lower, upper, share = F.max(F.when(F.col("side") == 0, v)), F.max(F.when(F.col("side") == 1, v)), F.max("share")
    quantile = F.when(lower == upper, lower).otherwise((F.lit(1.0) - share) * lower + share * upper)
    points = ranks.groupBy(*keys, "i").agg(quantile.alias("q"))
    # One entry per asked probability.
    ordered = F.array_sort(F.collect_list(F.struct("i", "q")))
    return points.groupBy(*keys).agg(F.transform(ordered, lambda s: s["q"]).alias("quantiles"))


def _ranks(cells: DataFrame, keys: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Two rows per group and probability: the rank just below and the one just above the asked position."""
    asked = F.posexplode(F.lit(np.asarray(probabilities, dtype=float))).alias("i", "p")
    totals = cells.groupBy(*keys).agg(F.sum("w").alias("total")).select(*keys, "total", asked)
    position = (F.col("total") - 1) * F.col("p")
    totals = totals.withColumns({"position": position, "side": F.explode(F.array(F.lit(0), F.lit(1)))})
    rank = F.when(F.col("side") == 0, F.floor("position")).otherwise(F.ceil("position"))
    share = F.col("position") - F.floor("position")
    return totals.select(*keys, "i", "side", share.alias("share"), rank.alias("rank"))


def _place(ranks: DataFrame, cells: DataFrame, within: list[str], cell: str) -> DataFrame:
    """Adds the cell that holds each rank; the rank becomes the rank inside that cell."""
    order = Window.partitionBy(*within).orderBy(cell)
    start = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select(*within, cell, start.alias("at"), F.lit(0).alias("is_rank"))
    marks = starts.unionByName(
        ranks.withColumn("at", F.col("rank")).withColumn("is_rank", F.lit(1)), allowMissingColumns=True
    )
    before = Window.partitionBy(*within).orderBy("at", "is_rank")
    begin = F.last(F.when(F.col("is_rank") == 0, F.col("at")), ignorenulls=True).over(before)
    placed = marks.withColumns({cell: F.last(cell, ignorenulls=True).over(before), "begin": begin})
    placed = placed.where(F.col("is_rank") == 1).withColumn("rank", F.col("rank") - F.col("begin"))
    return placed.drop("at", "is_rank", "begin")
