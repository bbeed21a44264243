"""Helpers of the corpus operators: written tables with a common life, and texts as bytes inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.session import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: space and \x09 to \x0D. bytes.split() uses the same characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one run, below one folder of the shared folder.

    Tables cut the lineage: after a lost executor a task reads files again. `drop` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self._count = spark, fresh_path(spark, label), 0
        # The frames are held too, so that an identity stands for one table only.
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self._count += 1
        path = f"{self.root}/{name}-{self._count}"
        df.write.option("compression", codec).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(written)] = (written, path)
        return written

    def drop(self, *written: DataFrame) -> None:
        for df in written:
            if id(df) in self._paths:
                self._delete(self._paths.pop(id(df))[1])

    def keep_only(self, *written: DataFrame) -> None:
        """Removes every table of the run but these."""
        kept = {id(df) for df in written}
        self.drop(*[df for key, (df, _) in self._paths.items() if key not in kept])

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


# Rows that cross to Python at once. Whole texts are long; a batch lies in memory on both sides, and as a list of its texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most BATCH_ROWS rows at once to Python, or fewer if it is set so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = int(spark.conf.get(name))
    if not 0 < set_to <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unused(columns: list[str], name: str) -> str:
    """`name`, longer if a column is already called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(column, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a text column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def row_numbers() -> Iterator[int]:
    """Numbers no other task of the job gives: the partition in the upper bits."""
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1
