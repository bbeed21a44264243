"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.verification.views import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, views: tuple[str, ...] = ("listing",)):
    """Registers a query. `views` are the derived views its SQL reads."""

    def register(run: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(run, with_views(sql, *views) if sql else None)
        return run

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    scale = F.lit(10.0**digits)
    return df.select(
        *[
            (F.rint(F.col(f.name) * scale) / scale).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def exploded(df: DataFrame, array: str, value: Column | None = None) -> DataFrame:
    """One row per array entry: position and value."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias("position", "value")).withColumn(
        "position", F.col("position").cast("bigint")
    )
