"""Categories as numbers: the smoothed mean of the label of their fit rows, one rule for any number of categories.

Fit rows are dealt to parts by a hash of their key. The mean that a fit row gets leaves its own part out, so no row sees its own
label; a member of an ensemble leaves out the parts of its own fold as well. One aggregation of all columns gives counts and
sums per (column, value, part), and every mean is a difference of those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.session import BroadcastBudget, fresh_path, joinable

# A category's mean is drawn to the overall mean as if this many rows had it.
PRIOR_ROWS = 10.0


def count_categories(rows: DataFrame, columns: Sequence[str], label: str, part: Column) -> DataFrame:
    """(column, value, part, n, total): one scan, combined before the shuffle. Missing categories are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    # The part is drawn before a row becomes one per column.
    drawn = rows.select(pairs.alias("pairs"), F.col(label).alias("y"), part.cast("int").alias("part"))
    stacked = drawn.select(F.inline("pairs"), "y", "part").where("value is not null")
    return stacked.groupBy("column", "value", "part").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


def count_rows(rows: DataFrame, label: str, part: Column, parts: int) -> tuple[list[int], list[float]]:
    """Rows and sum of the labels of each part."""
    found = rows.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum(label).alias("total")).collect()
    by_part = {r["part"]: (r["n"], r["total"] or 0.0) for r in found}
    return [by_part.get(p, (0, 0.0))[0] for p in range(parts)], [by_part.get(p, (0, 0.0))[1] for p in range(parts)]


@dataclass(frozen=True)
class TargetStatistics:
    """Per column a table (value, n, total) of arrays: an entry per part, then one per member, of all parts that it uses.

    `n` and `total` are the same over all rows, per part; `members` are the parts that each member leaves out.
    """

    tables: Mapping[str, DataFrame]
    n: Sequence[int]
    total: Sequence[float]
    members: Sequence[Sequence[int]] = ((),)
    prior_rows: float = PRIOR_ROWS

    @property
    def parts(self) -> int:
        return len(self.n)

    def attach(self, df: DataFrame) -> DataFrame:
        """Adds the counts of each row's categories, as `<column>_n` and `<column>_total`: one join per column."""
        for column, table in self.tables.items():
            counts = table.select(
                F.col("value").alias("statistics_value"), F.col("n").alias(f"{column}_n"), F.col("total").alias(f"{column}_total")
            )
            df = df.join(counts, F.col(column).cast("string") == F.col("statistics_value"), "left").drop("statistics_value")
        return df

    def _prior(self, left_out: set[int]) -> float:
        used = [p for p in range(self.parts) if p not in left_out]
        rows = sum(self.n[p] for p in used)
        return sum(self.total[p] for p in used) / rows if rows else 0.0

    def mean(self, column: str, member: int = 0, own: Column | None = None) -> Column:
        """Smoothed mean over the member's parts but the row's `own` one (-1 for none), of a frame that `attach` has given its counts."""
        left_out = set(self.members[member])
        own = F.lit(-1) if own is None else own
        inside = (own >= 0) & ~own.isin(*left_out) if left_out else own >= 0
        # The overall mean without each part, the one without any first.
        priors = [self._prior(left_out)] + [self._prior(left_out | {p}) for p in range(self.parts)]
        prior = F.get(F.array(*[F.lit(float(p)) for p in priors]), F.when(inside, own + 1).otherwise(0).cast("int"))

        def counted(name: str) -> Column:
            entries = F.col(f"{column}_{name}")
            part = F.when(inside, F.get(entries, own.cast("int"))).otherwise(0)
            return F.coalesce((F.get(entries, F.lit(self.parts + member)) - part).cast("double"), F.lit(0.0))

        return (counted("total") + prior * self.prior_rows) / (counted("n") + self.prior_rows)


def fit_target_statistics(
    counts: DataFrame,
    columns: Sequence[str],
    n: Sequence[int],
    total: Sequence[float],
    members: Sequence[Sequence[int]] = ((),),
    prior_rows: float = PRIOR_ROWS,
) -> TargetStatistics:
    """From the written result of `count_categories` and `count_rows`. Each table is joined by its own measured size."""
    parts = len(n)
    by_part = F.map_from_entries(F.collect_list(F.struct("part", F.struct("n", "total"))))
    packed = counts.where(F.col("column").isin(list(columns))).groupBy("column", "value").agg(by_part.alias("by_part"))
    places = F.sequence(F.lit(0), F.lit(parts - 1))

    def entries(name: str, zero: Column) -> Column:
        by_place = F.transform(places, lambda p: F.coalesce(F.col("by_part")[p][name], zero))

        def used(left_out: Sequence[int]) -> Column:
            kept = F.filter(by_place, lambda x, p: ~p.isin(*left_out)) if left_out else by_place
            return F.aggregate(kept, zero, lambda s, x: s + x)

        return F.concat(by_place, F.array(*[used(m) for m in members])).alias(name)

    packed = packed.select("column", "value", entries("n", F.lit(0).cast("bigint")), entries("total", F.lit(0.0)))
    spark = counts.sparkSession
    path = fresh_path(spark, "target-statistics")
    packed.write.partitionBy("column").parquet(path)
    schema = "value string, n array<bigint>, total array<double>"
    written = spark.read.schema(f"column string, {schema}").parquet(path)
    size = F.sum(F.octet_length("value") + 48 + 16 * (parts + len(members)))
    sizes = {r["column"]: r["size"] for r in written.groupBy("column").agg(size.alias("size")).collect()}
    budget = BroadcastBudget()
    tables = {c: joinable(spark.read.schema(schema).parquet(f"{path}/column={c}"), sizes[c], budget) for c in columns if c in sizes}
    empty = spark.createDataFrame([], schema)
    return TargetStatistics({c: tables.get(c, empty) for c in columns}, tuple(n), tuple(total), tuple(map(tuple, members)), prior_rows)
