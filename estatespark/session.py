"""Session settings and the shared folder that fitted tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Written tables of up to this many bytes of values are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
# What the broadcasts of one plan may add up to.
PLAN_BROADCAST_BYTES = 256 * 1024 * 1024


def build_session(app: str = "estatespark", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings this package relies on; `settings` override them (dots as `__`)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Wide rows behind several joins generate methods above the JVM's 8000-byte limit for compilation.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    base.update({key.replace("__", "."): str(value) for key, value in settings.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's `spark.checkpoint.dir`.

    Only a local session, where driver and executors are one machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="estatespark-"))
    return context.getCheckpointDir().rstrip("/")


# The folder of the run that the current thread works for.
_RUN: ContextVar[str | None] = ContextVar("estatespark_run", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables written inside lie in one folder below the shared one, which goes when the run ends, failed or not.

    What the run is to leave behind must be written elsewhere before the end. Runs may overlap in other threads or lie inside each
    other: each has a folder of its own. Threads that work for a run are given functions wrapped by `in_this_run`.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    outer = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(outer)
        remove_path(spark, folder)


def in_this_run(function: Callable) -> Callable:
    """`function` for other threads, so that it writes to the folder of the run that is open here and now."""
    here = copy_context()
    return lambda *arguments: here.copy().run(function, *arguments)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, or in the open run's, that nothing else uses."""
    return f"{_RUN.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder once and return the written table.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing, and makes the table's size known.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def value_bytes(table: DataFrame) -> Column:
    """Bytes of a row of flat columns: the length of texts, 16 for everything else."""
    total = F.lit(0).cast("bigint")
    for field in table.schema.fields:
        text = field.dataType.typeName() == "string"
        total = total + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 16 if text else F.lit(16))
    return total


class BroadcastBudget:
    """Bytes that the broadcasts of one plan may still take together."""

    def __init__(self, limit: int = PLAN_BROADCAST_BYTES):
        self.left = limit

    def take(self, size: int) -> bool:
        if size > min(self.left, BROADCAST_BYTES):
            return False
        self.left -= size
        return True


def joinable(table: DataFrame, size: int | None = None, budget: BroadcastBudget | None = None) -> DataFrame:
    """A written table, marked for broadcasting if its measured size and the plan's budget allow it.

    Without the mark Spark shuffles both sides and splits skewed partitions at run time, so a join is whole for any size.
    """
    if size is None:
        size = table.agg(F.sum(value_bytes(table))).first()[0] or 0
    return F.broadcast(table) if (budget or BroadcastBudget()).take(size) else table


def as_tables(
    df: DataFrame, label: str, column: str, names: list[str], budget: BroadcastBudget | None = None
) -> dict[str, DataFrame]:
    """Like `as_table`, as one table per value of `column`, each joinable by its own size. All sizes are measured at once."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    written = spark.read.schema(df.schema).parquet(path)
    size = F.sum(value_bytes(written)).alias("size")
    sizes = {r[column]: r["size"] for r in written.groupBy(column).agg(size).collect()}
    tables = {}
    for name in names:
        # A value without rows has no folder.
        if name in sizes:
            tables[name] = joinable(spark.read.schema(schema).parquet(f"{path}/{column}={name}"), sizes[name], budget)
        else:
            tables[name] = F.broadcast(spark.createDataFrame([], schema))
    return tables
